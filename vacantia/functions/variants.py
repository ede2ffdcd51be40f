"""Helpers on VARIANT values: truthiness, kind and text, without assuming a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON renderings that count as "missing" where the first present value of several is taken.
_FALSY = r'^(?:null|false|""|\[\]|\{\}|-?0(?:\.0*)?(?:[eE].*)?)$'


def parse(c: Column) -> Column:
    """VARIANT of a JSON text, null when malformed. A second value or other text behind the first makes it malformed too."""
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


# A text value of this size is the first thing that VARIANT cannot hold; no JSON text below it can break a limit.
LARGE = 16 << 20
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": "_bad"}


def is_large(c: Column) -> Column:
    return F.coalesce(F.octet_length(c) > LARGE, F.lit(False))


def parse_fields(c: Column, schema: str) -> Column:
    """Only the fields of `schema` of a large JSON text; the others are skipped unread, so the limits of VARIANT hold for single fields.

    Null for texts that are not large, for malformed ones, and when anything of the schema cannot be read.
    """
    text = F.when(is_large(c), F.concat(F.lit('{"v":['), c, F.lit("]}")))
    read = F.from_json(text, f"v ARRAY<{schema}>, _bad STRING", _STRICT)
    # Evaluated once: a value that does not fit leaves a null behind and the text in _bad.
    kept = F.transform(F.array(read), lambda r: F.when(r["_bad"].isNull() & (F.size(r["v"]) == 1), F.get(r["v"], F.lit(0))))
    return F.get(kept, F.lit(0))


def repacked(entries: Column) -> Column:
    """ARRAY<VARIANT> of typed entries, each with the fields it has."""
    return F.transform(entries, lambda e: F.try_parse_json(F.to_json(e)))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def raw(v: Column) -> Column:
    return F.to_json(v)


def truthy(v: Column) -> Column:
    return F.coalesce(~raw(v).rlike(_FALSY), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(raw(v).startswith('"'), F.lit(False))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def text(v: Column) -> Column:
    """Scalars as text, null for JSON null; objects and lists as JSON text."""
    return F.try_variant_get(v, "$", "string")


def items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def first_truthy(v: Column, names: list[str]) -> Column:
    """VARIANT of the first field that is present and not falsy; null if there is none."""
    return F.coalesce(*[F.when(truthy(field(v, n)), field(v, n)) for n in names])


def address(addr: Column) -> Column:
    """Locality, region and country of an address object joined with ', ', empty parts left out."""
    parts = [F.when(truthy(field(addr, n)), text(field(addr, n))) for n in ("addressLocality", "addressRegion", "addressCountry")]
    return F.concat_ws(", ", *parts)
