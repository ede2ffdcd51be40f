"""Postings inside page scripts: JSON-LD and embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import variants as J
from vacantia.functions import vocabulary as V
from vacantia.functions.text import contains_any, empty_to_null, not_blank, strip
from vacantia.functions.bind import bind
from vacantia.functions.urls import strip_fragment, with_absolute
from vacantia.operators.json_walk import json_objects
from vacantia.schemas import job

RANK_BOARD, RANK_EMBEDDED, RANK_LINKED_DATA, RANK_LINK = range(4)


def _objects(scripts: DataFrame, text: Column, linked: bool) -> DataFrame:
    keep = [c for c in scripts.columns if c not in ("body", "id_lc", "type_lc")]
    objects = scripts.select(*keep, json_objects(text, linked).alias("objects")).select(
        *keep, F.posexplode("objects").alias("walk_pos", "object")
    )
    return bind(objects, v=F.try_parse_json("object")).drop("object")


def _is_http(text: Column) -> Column:
    return strip(text).startswith("http")


# --- JSON-LD ------------------------------------------------------------------------------------


def _first_http(url: Column) -> Column:
    texts = F.transform(F.filter(J.items(url), J.is_text), J.text)
    return F.get(F.filter(texts, lambda t: t.startswith("http")), F.lit(0))


def _linked_location(loc: Column) -> Column:
    addr = J.field(loc, "address")
    first = F.get(J.items(loc), F.lit(0))
    first_addr = J.field(first, "address")
    return (
        F.when(J.is_object(loc) & J.is_object(addr), J.address(addr))
        .when(J.is_object(loc) & J.is_text(addr), J.text(addr))
        .when(J.is_list(loc) & J.is_object(first) & J.is_object(first_addr), J.address(first_addr))
    )


def linked_data_postings(scripts: DataFrame) -> DataFrame:
    """JobPosting objects of 'ld+json' scripts. Needs the script table plus page_url.

    Adds extractor, script_pos, walk_pos and job. A script that names no JobPosting (or hides it behind
    an escape) never leaves the JVM.
    """
    chosen = scripts.where(
        F.contains("type_lc", F.lit("ld+json")) & not_blank(F.col("body")) & F.col("body").rlike(r"JobPosting|\\u00")
    ).withColumnRenamed("pos", "script_pos")
    v = F.col("v")
    kind = J.field(v, "@type")
    is_posting = F.when(
        J.is_list(kind), F.exists(J.items(kind), lambda t: J.is_text(t) & (J.text(t) == "JobPosting"))
    ).otherwise(J.is_text(kind) & (J.text(kind) == "JobPosting"))
    found = _objects(chosen, strip(F.col("body")), linked=True).where(is_posting)
    found = bind(
        found,
        _title=J.field(v, "title"), _url=J.first_truthy(v, ["url", "sameAs"]), _location=J.field(v, "jobLocation"),
    )
    title, url, keep = F.col("_title"), F.col("_url"), found.columns
    found = bind(found, _url_text=F.when(J.is_text(url), strip(J.text(url))), _named=J.truthy(title) & not_blank(J.text(title)))
    found = bind(found.where("_named"), _local=F.when(F.col("_url_text").startswith("/"), F.col("_url_text")))
    found = with_absolute(found, "_joined", "page_url", "_local")
    address = F.coalesce(F.col("_joined"), strip_fragment(F.col("_url_text")), _first_http(url))
    return found.select(
        *[c for c in keep if not c.startswith("_") and c != "v"],
        F.lit(RANK_LINKED_DATA).alias("extractor"),
        job(source=F.lit("json_ld"), title=strip(J.text(title)), url=address, location=_linked_location(F.col("_location"))).alias("job"),
    )


# --- embedded JSON ------------------------------------------------------------------------------


def embedded_scripts(scripts: DataFrame) -> DataFrame:
    """Scripts that carry page data: marked as JSON, or a bundle with board objects."""
    kind, body = F.col("type_lc"), F.col("body")
    linked = F.contains(kind, F.lit("ld+json"))
    marked = (F.col("id_lc") == "__next_data__") | F.contains(kind, F.lit("application/json"))
    bundle = (
        kind.isin("", "text/javascript") & F.contains(body, F.lit("absolute_url"))
        & F.contains(F.lower(body), F.lit("greenhouse"))
    )
    return scripts.where(~linked & ((marked & not_blank(body)) | bundle)).withColumn(
        "body", F.when(marked, strip(body)).otherwise(body)
    )


def _embedded_location(loc: Column) -> Column:
    named = J.first_truthy(loc, ["name", "title"])
    addr = J.field(loc, "address")
    return (
        F.when(J.is_object(loc) & named.isNotNull(), J.text(named))
        .when(J.is_object(loc) & J.is_object(addr), J.address(addr))
        .when(J.is_text(loc), J.text(loc))
    )


def embedded_postings(scripts: DataFrame) -> DataFrame:
    """Job-like objects of embedded JSON. Needs the script table plus page_url."""
    chosen = embedded_scripts(scripts).where(contains_any(F.col("body"), ["\\u00", *V.JOB_HINT_KEYS])).withColumnRenamed("pos", "script_pos")
    v = F.col("v")
    found = bind(_objects(chosen, F.col("body"), linked=False), _title=J.first_truthy(v, V.EMBEDDED_TITLE_KEYS))
    title = F.col("_title")
    found = bind(found.where(J.is_text(title)), _title=strip(J.text(title)))
    found = found.where((F.length(title) >= 2) & ~F.lower(title).isin(V.EMBEDDED_TITLE_BLOCK))

    text_of = lambda name: F.when(J.is_text(J.field(v, name)), J.text(J.field(v, name)))
    http_text = lambda name: F.regexp_extract(strip(text_of(name)), "(?s)^http.*", 0)
    named = F.coalesce(*[empty_to_null(http_text(k)) for k in V.EMBEDDED_URL_KEYS])
    found = bind(
        found,
        _named=empty_to_null(strip_fragment(named)), _plain=text_of("url"),
        _location=J.first_truthy(v, ["location", "jobLocation"]), _apply=J.first_truthy(v, ["applyUrl", "apply_url"]),
    )
    plain, apply_url = F.col("_plain"), F.col("_apply")
    marked = F.lower(plain).rlike("|".join(V.EMBEDDED_URL_MARKERS))
    found = bind(
        found,
        _marked=F.when(_is_http(plain) & marked, strip_fragment(strip(plain))),
        _local=F.when(F.col("_named").isNull() & strip(plain).startswith("/"), strip(plain)),
    )
    found = with_absolute(found, "_joined", "page_url", "_local")
    found = bind(found, _address=F.coalesce("_named", "_marked", empty_to_null(strip_fragment(F.col("_joined"))))).where("_address IS NOT NULL")
    return found.select(
        *[c for c in chosen.columns if c not in ("body", "id_lc", "type_lc")],
        "walk_pos",
        F.lit(RANK_EMBEDDED).alias("extractor"),
        job(
            source=F.lit("embedded_json"),
            title=title,
            url=F.col("_address"),
            location=_embedded_location(F.col("_location")),
            apply_url=F.when(J.is_text(apply_url) & _is_http(J.text(apply_url)), strip_fragment(strip(J.text(apply_url)))),
        ).alias("job"),
    )
