"""URL expressions: root, join, host, path, segments.

Native string expressions only. `parse_url` is avoided: under ANSI mode it fails the job on a bad URL, and
its tolerant form returns null for hosts with '_' and paths with spaces, both of which occur in real links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.bind import bind
from vacantia.functions.text import not_blank, strip

_SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*"
_NETLOC = f"^(?:{_SCHEME}:)?//([^/?#]*)"
_PATH = f"(?s)^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)"


def strip_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def normalize_website(url: Column) -> Column:
    """Root of a company website, 'scheme://netloc', or null when there is none."""
    u = strip(url)
    u = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))
    root = F.regexp_extract(u, "^https?://[^/?#]+", 0)
    return F.when(not_blank(url) & (root != ""), root)


def _after_scheme(url: str) -> str:
    return f"CASE WHEN startswith({url}, 'https://') THEN substr({url}, 9) WHEN startswith({url}, 'http://') THEN substr({url}, 8) END"


def _until(text: str, marks: str) -> str:
    for m in marks:
        text = f"substring_index({text}, '{m}', 1)"
    return text


def host(url: str) -> Column:
    """Host of a URL column in lower case without user, port and a leading 'www.'; '' when there is none.

    Web addresses, nearly all there are, are cut with plain string functions; others by pattern.
    """
    place = f"coalesce({_until(_after_scheme(url), '/?#')}, regexp_extract({url}, '{_NETLOC}', 1))"
    return F.expr(rf"""element_at(transform(array({place}), p -> regexp_replace(lower(CASE
      WHEN contains(p, '@') OR contains(p, '[') THEN coalesce(nullif(regexp_extract(p, r'(?s)^(?:.*@)?\[([^\]]*)', 1), ''), regexp_extract(p, '(?s)^(?:.*@)?([^:@]*)', 1))
      ELSE substring_index(p, ':', 1) END), '^www[.]', '')), 1)""")


def path(url: str) -> Column:
    """Path of a URL column; for web URLs without the ';parameters' of its last segment."""
    web = f"({_until(_after_scheme(url), '?#')})"
    web_path = f"CASE WHEN contains({web}, '/') THEN substr({web}, locate('/', {web})) WHEN {web} IS NOT NULL THEN '' END"
    p = f"coalesce({web_path}, regexp_extract({url}, '{_PATH}', 1))"
    return F.expr(f"""CASE WHEN contains({url}, ';') AND ({url} RLIKE '^(?i)https?:' OR NOT {url} RLIKE '^{_SCHEME}:')
      THEN regexp_replace({p}, ';[^/]*$', '') ELSE {p} END""")


def path_segments(p: Column) -> Column:
    """Lower-cased non-empty segments of a path."""
    return F.array_remove(F.split(F.lower(p), "/"), "")


def last_segment(p: Column) -> Column:
    """Last non-empty segment in lower case, '' if none, without anything from a '?' on."""
    return F.split_part(F.lower(F.regexp_extract(p, "([^/]+)/*$", 1)), F.lit("?"), F.lit(1))


def trim_slashes(c: Column) -> Column:
    """Drop trailing slashes."""
    return F.rtrim(c, F.lit("/"))


# Resolve '.' and '..' segments of a path; a path ending in one of them ends in '/'.
_RESOLVE_DOTS = """concat(
  array_join(aggregate(split(_merged, '/'), CAST(array() AS ARRAY<STRING>), (done, seg) -> CASE
    WHEN seg = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) WHEN seg = '.' THEN done ELSE concat(done, array(seg)) END), '/'),
  CASE WHEN _merged RLIKE '/[.][.]?$' THEN '/' ELSE '' END)"""


def base_parts(base: Column) -> Column:
    """What a join needs of its base, taken as a folder: a '/' is added at its end.

    The added slash lands in the query when the base has one. Compute it once per page, not per link.
    """
    b = F.when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))
    scheme = F.lower(F.regexp_extract(b, f"^({_SCHEME}):", 1))
    b_path = F.regexp_extract(b, _PATH, 1)
    return F.struct(
        b.alias("url"),
        scheme.alias("scheme"),
        F.concat(scheme, F.lit("://"), F.regexp_extract(b, _NETLOC, 1)).alias("origin"),
        b_path.alias("path"),
        F.regexp_extract(b_path, "(?s)^(?:.*/)?", 0).alias("folder"),
        F.regexp_extract(b, r"(?s)^[^?#]*(\?[^#]+)", 1).alias("query"),
    )


def with_absolute(df: DataFrame, out: str, base: str, href: str) -> DataFrame:
    """Add `out`: the address `href` joined to `base`.

    `base` names a text column or a `base_parts` column. Relative paths lose empty inner segments, root-relative
    ones keep them. An address with another scheme than the base is returned as it is.
    """
    columns = df.columns
    if dict(df.dtypes)[base] == "string":
        df = bind(df, _base=base_parts(F.col(base)))
        base = "_base"
    df = bind(
        df,
        _href=f"translate({href}, '\\t\\r\\n', '')",
        _scheme=f"CASE WHEN contains({href}, ':') THEN lower(regexp_extract({href}, '^({_SCHEME}):', 1)) ELSE '' END",
    )
    df = bind(df, _rest="CASE WHEN _scheme = '' THEN _href ELSE substr(_href, length(_scheme) + 2) END")
    # An empty host after '//' is no host.
    df = bind(df, _rest="CASE WHEN startswith(_rest, '//') AND _rest RLIKE '^//(?:[/?#]|$)' THEN substr(_rest, 3) ELSE _rest END")
    df = bind(df, _path="substring_index(substring_index(_rest, '#', 1), '?', 1)", _lead="substring_index(_rest, '#', 1)")
    # A '?' or '#' with nothing behind it disappears.
    df = bind(
        df,
        _query="CASE WHEN length(_lead) > length(_path) + 1 THEN substr(_lead, length(_path) + 1) ELSE '' END",
        _fragment="CASE WHEN length(_rest) > length(_lead) + 1 THEN substr(_rest, length(_lead) + 1) ELSE '' END",
        _merged=f"CASE WHEN startswith(_path, '/') THEN _path ELSE concat({base}.folder, _path) END",
    )
    dots = "(contains(_merged, '/.') OR startswith(_merged, '.')) AND _merged RLIKE '(?:^|/)[.][.]?(?:/|$)'"
    df = bind(df, _merged="CASE WHEN contains(_merged, '//') AND NOT startswith(_path, '/') THEN regexp_replace(_merged, '/{2,}', '/') ELSE _merged END")
    df = bind(df, _merged=f"CASE WHEN {dots} THEN {_RESOLVE_DOTS} ELSE _merged END")
    joined = f"""CASE
      WHEN {href} = '' THEN {base}.url
      WHEN _scheme <> '' AND _scheme <> {base}.scheme THEN {href}
      WHEN startswith(_rest, '//') THEN concat({base}.scheme, ':', _path, _query, _fragment)
      WHEN _path = '' THEN concat({base}.origin, {base}.path, CASE WHEN _query = '' THEN {base}.query ELSE _query END, _fragment)
      ELSE concat({base}.origin, CASE WHEN startswith(_merged, '/') THEN '' ELSE '/' END, _merged, _query, _fragment) END"""
    return bind(df, **{out: joined}).select(*[c for c in columns if c != out], out)
