"""Whitespace, title and HTML-text expressions. Everything here is a native Column expression."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character the source data model treats as whitespace (not only the space Spark's trim removes).
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# The same as a character class; the Unicode class is checked much faster than a list of characters.
WS = r"\s\x1c-\x1f"
_WS_RUN = f"(?U)[{WS}]+"


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def not_blank(c: Column) -> Column:
    """True for a non-null value with at least one non-whitespace character."""
    return F.coalesce(strip(c) != "", F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether one of the lower-case words occurs in any case: plain search, much cheaper on long texts than a case-blind pattern."""

    def search(low: Column) -> Column:
        found = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            found |= F.contains(low, F.lit(w))
        return found

    return F.exists(F.array(F.lower(c)), search)


def collapse(c: Column) -> Column:
    """Whitespace runs become one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, _WS_RUN, " "))


def normalize_title(c: Column) -> Column:
    """Lower case and collapsed whitespace."""
    return collapse(F.lower(c))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# --- character references -------------------------------------------------------------------

# References that nearly all pages are limited to; '&amp;' goes last so nothing is decoded twice.
_COMMON = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "\\'"),
    ("&#x27;", "\\'"),
    ("&#34;", '"'),
    ("&#x2F;", "/"),
    ("&nbsp;", "\u00a0"),
    ("&amp;", "&"),
)
_NOT_COMMON = "&(?!(?:amp|lt|gt|quot|nbsp|#39|#x27|#34|#x2F);)(?:#[0-9xX]|[a-zA-Z])"

# The HTML standard's tables, taken from the Python library. As one text each: '\x02' name '\x03' characters.
_NAMED = {k: v for k, v in html5.items() if k.endswith(";")}
_LEGACY = {k: v for k, v in html5.items() if not k.endswith(";")}
_LEGACY_NAME = "^(?:" + "|".join(sorted(_LEGACY, key=len, reverse=True)) + ")"
# Numbers 128-159 mean the Windows code page.
_WINDOWS = {str(i): bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _lookup(table: dict[str, str], key: str) -> str:
    """SQL: entry of a table, null if there is none. A text literal costs the optimizer nothing, a map literal much."""
    escapes = str.maketrans({"\\": "\\\\", "'": "\\'"})
    rows = "".join(f"\x02{k}\x03{v.translate(escapes)}" for k, v in table.items()) + "\x02"
    mark = f"concat('\x02', {key}, '\x03')"
    return f"CASE WHEN contains('{rows}', {mark}) THEN substring_index(substring_index('{rows}', {mark}, -1), '\x02', 1) END"


_CHAR = "decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32')"
# Character of a code point n. Code points that no page may hold vanish.
_CODE_POINT = f"""CASE
  WHEN n BETWEEN 128 AND 159 THEN coalesce({_lookup(_WINDOWS, "CAST(n AS STRING)")}, {_CHAR})
  WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '\ufffd'
  WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR (n >= 65534 AND n % 65536 >= 65534) THEN ''
  ELSE {_CHAR} END"""
# Code point of a numeric reference r; anything too long is out of range.
_NUMBER = """CASE
  WHEN r RLIKE '^#[xX]0*+[0-9a-fA-F]{7}' OR r RLIKE '^#0*+[0-9]{8}' THEN 1114112L
  WHEN r RLIKE '^#[xX]' THEN CAST(conv(regexp_extract(r, '^#[xX]([0-9a-fA-F]+)', 1), 16, 10) AS BIGINT)
  ELSE CAST(regexp_extract(r, '^#([0-9]+)', 1) AS BIGINT) END"""


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _decode_piece(attribute: bool) -> str:
    """SQL: text p after one '&', with the reference it starts with (if any) decoded."""
    rest = "substr(p, length(r) + 1)"
    number = _let("r", "regexp_extract(p, '^#(?:[xX][0-9a-fA-F]+|[0-9]+);?', 0)", f"concat({_let('n', _NUMBER, _CODE_POINT)}, {rest})")
    named = _let("r", "regexp_extract(p, '^[a-zA-Z][a-zA-Z0-9]*;', 0)", f"concat({_lookup(_NAMED, 'r')}, {rest})")
    legacy = f"concat({_lookup(_LEGACY, 'r')}, {rest})"
    if attribute:
        legacy = f"CASE WHEN NOT {rest} RLIKE '^[=a-zA-Z0-9]' THEN {legacy} END"
    legacy = _let("r", f"regexp_extract(p, '{_LEGACY_NAME}', 0)", legacy)
    # The common ones first: they need no table.
    common = " ".join(f"WHEN startswith(p, '{r[1:]}') THEN concat('{c}', substr(p, {len(r)}))" for r, c in _COMMON)
    return (
        f"CASE {common} WHEN p RLIKE '^#(?:[xX][0-9a-fA-F]|[0-9])' THEN {number} "
        f"WHEN p RLIKE '^[a-zA-Z]' THEN coalesce({named}, {legacy}, concat('&', p)) ELSE concat('&', p) END"
    )


def unescape(column: str, attribute: bool = False) -> Column:
    """Decode the HTML character references of a text column.

    Three tiers, cheapest first: no '&' at all, only common references (plain replaces), anything else
    (split at '&' and decode each piece). In an attribute, a reference without ';' that runs into a
    letter, digit or '=' is left alone, so query strings such as '?a=1&copy=2' survive.
    """
    common = column
    for ref, char in _COMMON:
        common = f"replace({common}, '{ref}', '{char}')"
    # Each piece but the first followed a '&'.
    every = f"array_join(transform(split({column}, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {_decode_piece(attribute)} END), '')"
    return F.expr(
        f"CASE WHEN NOT contains({column}, '&') THEN {column} WHEN NOT {column} RLIKE '{_NOT_COMMON}' THEN {common} ELSE {every} END"
    )
