"""The directory's own job listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import variants as J
from vacantia.functions import vocabulary as V
from vacantia.functions.bind import bind
from vacantia.functions.text import unescape
from vacantia.schemas import job


# What is read of page data that is too large to be read whole.
_FIELDS = "title: VARIANT, location: VARIANT, type: VARIANT, url: VARIANT, applyUrl: VARIANT, salaryRange: VARIANT"
_PAGE_DATA = f"STRUCT<props: STRUCT<jobPostings: ARRAY<STRUCT<{_FIELDS}>>>>"


def listings_url(slug: Column) -> Column:
    return F.concat(F.lit(V.LISTINGS_PAGE[0]), F.coalesce(slug, F.lit("")), F.lit(V.LISTINGS_PAGE[1]))


def _listing(p: Column) -> Column:
    url = J.text(J.field(p, "url"))
    text = lambda name: J.text(J.field(p, name))
    return job(
        title=text("title"),
        location=text("location"),
        type=text("type"),
        url=F.when(url.startswith("/"), F.concat(F.lit(V.DIRECTORY_HOST), url)).otherwise(url),
        apply_url=text("applyUrl"),
        salary_range=text("salaryRange"),
    )


def listing_pages(responses: DataFrame) -> DataFrame:
    """Latest listings page per address: request_url, fault, jobs ARRAY<STRUCT<title, ...>>.

    A status of 400 or more, a failed transfer, and page data that is not valid are faults. A page without
    page data is just empty.
    """
    prefix, suffix = V.LISTINGS_PAGE
    payload, data, root, fields, listed = F.col("_payload"), F.col("_data"), F.col("_root"), F.col("_fields"), F.col("_listed")
    postings = F.try_variant_get(root, "$.props.jobPostings", "variant")
    has_props = J.is_object(root) & (J.field(root, "props").isNull() | J.is_object(J.field(root, "props")))
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status") >= 400, F.concat(F.lit("listings: HTTP status "), F.col("status").cast("string")))
        .when(payload == "", None)
        .when(root.isNull() & J.is_large(data) & (fields.isNull() | F.exists(listed, lambda p: p.isNull())), F.lit("listings: page data is beyond the size limits or malformed"))
        .when(root.isNull() & fields.isNull(), F.lit("listings: page data is not valid JSON"))
        .when(root.isNotNull() & ~has_props, F.lit("listings: page data has no job list"))
        .when(listed.isNull() & J.truthy(postings), F.lit("listings: page data has no job list"))
        .when(F.exists(listed, lambda p: J.field(p, "title").isNull() & ~J.is_object(p)), F.lit("listings: broken entry in the job list"))
    )
    address = F.col("request_url")
    pages = responses.where((F.col("render") == "http") & address.startswith(prefix) & address.endswith(suffix))
    pages = bind(pages, _payload=F.regexp_extract(F.coalesce("body", F.lit("")), 'data-page="([^"]+)"', 1))
    pages = bind(pages, _data=unescape("_payload"))
    pages = bind(pages, _root=J.parse(data))
    pages = bind(pages, _fields=F.when(root.isNull(), J.parse_fields(data, _PAGE_DATA)))
    pages = bind(pages, _listed=F.when(root.isNotNull(), J.items(postings)).otherwise(J.repacked(fields["props"]["jobPostings"])))
    return (
        bind(pages, fault=fault)
        .select("request_url", "fetched_at", "fault", F.when(F.col("fault").isNull(), F.transform(listed, _listing)).alias("jobs"))
        .groupBy("request_url")
        .agg(F.max_by(F.struct("fault", "jobs"), F.struct("fetched_at", "fault")).alias("p"))
        .select("request_url", "p.fault", "p.jobs")
    )
