"""Records to the flat 15-column table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V


def flatten_records(records: DataFrame) -> DataFrame:
    """Three shapes by source; any other source counts as careers postings.

    Company fields, and stage and error of error rows, stay null when missing; all else becomes ''.
    """
    source, job = F.col("source"), F.col("job")
    error, listing = source.eqNullSafe(V.SOURCE_ERROR), source.eqNullSafe(V.SOURCE_LISTINGS)
    careers = ~error & ~listing
    shown = lambda ok, c: F.when(ok, F.coalesce(c, F.lit(""))).otherwise(F.lit(""))
    columns = {
        "source": F.when(error | listing, source).otherwise(F.lit(V.SOURCE_CAREERS)),
        "company_name": F.col("company.yc_name"),
        "company_slug": F.col("company.yc_slug"),
        "batch": F.col("company.batch"),
        "website": F.col("company.website"),
        "job_title": shown(~error, job["title"]),
        "location": shown(~error, job["location"]),
        "job_url": shown(~error, job["url"]),
        "apply_url": shown(~error, job["apply_url"]),
        "careers_url": shown(careers, F.col("careers_url")),
        "salary_range": shown(listing, job["salary_range"]),
        "job_type": shown(listing, job["type"]),
        "job_source": shown(careers, job["source"]),
        "stage": F.when(error, F.col("stage")).otherwise(F.lit("")),
        "error": F.when(error, F.col("error")).otherwise(shown(careers, F.col("note"))),
    }
    return records.select(*[columns[n].alias(n) for n in V.CSV_FIELDS], *[c for c in ("shard",) if c in records.columns])
