"""Page tables: anchors and scripts of captured pages in document order.

Pages are cut with linear, non-backtracking patterns on the JVM; the few that these would misread are written anew
first (`markup`). What a tolerant tree parser would do differently is listed in the README.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V
from vacantia.functions.bind import bind
from vacantia.functions.text import WS, collapse, contains_any, empty_to_null, strip, unescape
from vacantia.functions.urls import strip_fragment
from vacantia.operators.markup import misread, plain_form
from vacantia.schemas import carried

# Attributes of a start tag up to its '>'; quotes count only as values after '='.
_ATTRS = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+"""
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_COMMENT = r"!--(?:[^-]|-(?!->))*+(?:-->)?"
_RAW = r"[^<]*+(?:<(?!/{0}[\s/>])[^<]*+)*+(?:</{0}\s*+>)?"
_INVISIBLE = rf"(?i)<(?:{_COMMENT}|(script|style)(?=[\s/>]){_ATTRS}>{_RAW.format(chr(92) + '1')})"
_SCRIPT = rf"(?i)<(?:{_COMMENT}|script(?=[\s/>]){_ATTRS}>{_RAW.format('script')})"
# An anchor runs to its end tag or to the next anchor, as anchors cannot nest.
_ANCHOR = rf"(?is)<a(?=[\s/>]){_ATTRS}>[^<]*+(?:<(?!/?a[\s/>])[^<]*+)*+"
_TAG = rf"(?s)</?[a-zA-Z]{_ATTRS}>|<[!?][^>]*+>"
_CUT = "\x01"

# Scripts without any of these words cannot hold a posting. A \u escape may hide one of them.
_POSTING_WORDS = ["jobposting", "\\u00", *V.JOB_HINT_KEYS]
_ATS_HOSTS = V.ATS_HOST.strip("()").replace("\\", "").split("|")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of the start tag at the head of `tag`, not decoded; '' if absent or empty."""
    other = rf"""(?:[\s/]+|(?<=["']))(?!{name}[\s=/>])[^\s/>=]++(?:\s*+=\s*+{_VALUE.replace('(', '(?:', 1)}?)?+"""
    value = F.regexp_extract(tag, rf"""(?is)^<[a-z]+(?:{other})*+(?:[\s/]+|(?<=["'])){name}\s*+=\s*+{_VALUE}""", 1)
    # Quotes in a value not written with quotes are rare and not paired, so pairs can be cut off by pattern.
    return F.regexp_replace(value, "(?s)^([\"'])(.*)\\1$", "$2")


def visible(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, _INVISIBLE, "<!>")


def _anchors(visible: Column) -> Column:
    return F.regexp_extract_all(visible, F.lit(_ANCHOR), F.lit(0))


def anchor_blocks(html: Column) -> Column:
    """ARRAY<STRING> of the anchors, each from '<a' to before its end tag. Scripts, styles and comments are left out."""
    return _anchors(visible(html))


def script_blocks(html: Column) -> Column:
    """ARRAY<STRING> of the script elements outside comments."""
    return F.filter(F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(0)), lambda s: ~s.startswith("<!"))


def with_blocks(pages: DataFrame, html: str) -> DataFrame:
    """Add `anchors` and `scripts` (see `anchor_blocks`, `script_blocks`) of a page column, of misread pages from their plain form."""
    seen = bind(pages, _visible=visible(F.col(html)))
    seen = bind(seen, anchors=_anchors(F.col("_visible")), _misread=F.when(misread(F.col(html), F.col("_visible")), F.col(html)))
    seen = seen.drop("_visible").withColumn("_plain", plain_form(F.col("_misread")))
    anew = F.col("_plain").isNotNull()
    return bind(
        seen, anchors=F.when(anew, anchor_blocks(F.col("_plain"))).otherwise(F.col("anchors")),
        scripts=script_blocks(F.coalesce("_plain", html)),
    ).drop("_misread", "_plain")


def _tagged(tokens: Column, tag: list[Column]) -> Column:
    return F.transform(tokens, lambda t: F.struct(*tag, t.alias("token")))


def board_tokens(html: Column) -> Column:
    """ARRAY<STRUCT<vendor_rank, vendor, token>> of the hiring boards named in a page, each once."""
    found = []
    patterns = {"greenhouse": V.GREENHOUSE_IN_TEXT, "lever": V.LEVER_IN_TEXT, "ashby": V.ASHBY_IN_URL}
    for rank, (vendor, pattern) in enumerate(patterns.items()):
        tokens = F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)" + pattern), F.lit(1)))
        # The token pattern has no dot, so no file name ('.js', '.css', '.png') can be among them.
        tokens = F.filter(tokens, lambda t: F.length(t) >= 2)
        if vendor == "ashby":
            tokens = F.filter(tokens, lambda t: ~F.lower(t).isin(V.ASHBY_RESERVED))
        tag = [F.lit(rank).alias("vendor_rank"), F.lit(vendor).alias("vendor")]
        found.append(_tagged(tokens, tag))
    return F.concat(*found)


def page_address() -> Column:
    """Address a capture ended at, without fragment."""
    return strip_fragment(F.coalesce(empty_to_null(F.col("final_url")), F.col("request_url")))


def page_parts(pages: DataFrame) -> DataFrame:
    """One row per captured page with only the parts that later steps read; the body is dropped here.

    Map-only: one scan of the archive, no shuffle. Input columns: request_url, render, fetched_at,
    final_url, body; `ident` is kept if there is one.
    """
    body, no_boards = F.col("body"), F.array().cast("array<struct<vendor_rank:int,vendor:string,token:string>>")
    # A page without a board host's name has no board tokens either: one scan of the body decides both.
    has_ats_text = contains_any(body, _ATS_HOSTS)
    return bind(with_blocks(pages, "body"), has_ats_text=has_ats_text).select(
        "request_url", "render", "fetched_at",
        page_address().alias("page_url"),
        body.rlike(f"(?U)[^{WS}]").alias("has_text"),
        "has_ats_text",
        "anchors",
        F.filter("scripts", lambda s: contains_any(s, _POSTING_WORDS)).alias("scripts"),
        F.when(F.col("has_ats_text"), board_tokens(body)).otherwise(no_boards).alias("boards"),
        *carried(pages),
    )


def explode_anchors(df: DataFrame, blocks: str = "anchors") -> DataFrame:
    """One row per anchor: pos, href, text, aria_label, title_attr, label. Other columns are kept."""
    keep = [c for c in df.columns if c != blocks]
    block = F.col("_block")
    rows = df.select(*keep, F.posexplode(blocks).alias("pos", "_block"))
    # Attribute values are decoded together, cut apart by a control character that is taken out of the page before; references
    # to it are none.
    rows = bind(rows, _block=F.replace("_block", F.lit(_CUT), F.lit("")))
    rows = bind(rows, _low=F.lower("_block"))
    maybe = lambda n: F.when(F.contains("_low", F.lit(n)), attribute(block, n)).otherwise("")
    attrs = F.concat_ws(_CUT, attribute(block, "href"), maybe("aria-label"), maybe("title"))
    inner = F.regexp_replace(F.regexp_replace(block, rf"(?is)^<a{_ATTRS}>", ""), _TAG, _CUT)
    rows = bind(rows, _attrs=attrs, _inner=inner)
    rows = bind(rows, _attrs=unescape("_attrs", attribute=True), _inner=unescape("_inner"))
    inner, attr = F.col("_inner"), lambda i: strip(F.split_part("_attrs", F.lit(_CUT), F.lit(i)))
    cut = F.contains(inner, F.lit(_CUT))
    # Text of each child stripped, joined with one space.
    children = F.when(cut, F.regexp_replace(inner, f"(?U)[{WS}]*+{_CUT}[{WS}{_CUT}]*+", " ")).otherwise(inner)
    rows = bind(
        rows, href=attr(1), aria_label=attr(2), title_attr=attr(3),
        text=collapse(F.replace(inner, F.lit(_CUT), F.lit(""))), _children=strip(children),
    )
    label = F.concat_ws(" ", *[empty_to_null(F.col(c)) for c in ("aria_label", "title_attr", "_children")])
    return rows.select(*keep, "pos", "href", "text", "aria_label", "title_attr", label.alias("label"))


def explode_scripts(df: DataFrame, blocks: str = "scripts") -> DataFrame:
    """One row per script element: pos, id_lc, type_lc, body. Other columns are kept."""
    keep = [c for c in df.columns if c != blocks]
    rows = df.select(*keep, F.posexplode(blocks).alias("pos", "_block"))
    name = lambda n: F.lower(attribute(F.col("_block"), n))
    body = F.regexp_replace("_block", rf"(?is)^<script{_ATTRS}>|</script\s*>$", "")
    return bind(rows, id_lc=name("id"), type_lc=name("type"), body=body).drop("_block")
