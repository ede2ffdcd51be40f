"""Declared schemas of the pipeline's inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.vocabulary import CSV_FIELDS

COMPANIES = (
    "dir_page INT, pos INT, slug STRING, object_id STRING, name STRING, website STRING, batch STRING, is_hiring BOOLEAN"
)
# One row per (request_url, render, fetched_at).
RESPONSES = (
    "request_url STRING, render STRING, final_url STRING, status INT, content_type STRING, body STRING, "
    "error STRING, fetched_at TIMESTAMP"
)
#: Names what a capture says, whenever it was taken (see `vacantia.plans.cuts`).
IDENT = "ident"
JOB_FIELDS = ["source", "title", "url", "location", "apply_url", "type", "salary_range"]
JOB = "STRUCT<" + ", ".join(f"{n}: STRING" for n in JOB_FIELDS) + ">"
COMPANY = "STRUCT<yc_slug: STRING, yc_name: STRING, website: STRING, batch: STRING>"
RECORDS = f"source STRING, company {COMPANY}, careers_url STRING, job {JOB}, note STRING, stage STRING, error STRING"
FLAT = ", ".join(f"{n} STRING" for n in CSV_FIELDS)


def carried(df: DataFrame) -> list[str]:
    """The identity of the capture, where the table has it; page tables made from it keep it."""
    return [IDENT] if IDENT in df.columns else []


def job(**fields: Column) -> Column:
    """A job struct with every field; those not given are null."""
    null = F.lit(None).cast("string")
    return F.struct(*[fields.get(n, null).cast("string").alias(n) for n in JOB_FIELDS])
