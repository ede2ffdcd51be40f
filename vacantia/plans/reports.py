"""Counts over flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import not_blank


def run_summary(flat: DataFrame) -> DataFrame:
    """One row: all rows, and rows with a job title."""
    return flat.agg(F.count("*").alias("n_rows"), F.count_if(not_blank(F.col("job_title"))).alias("n_titled"))


def jobs_per_company(flat: DataFrame) -> DataFrame:
    return flat.where(not_blank(F.col("job_title"))).groupBy("company_slug").agg(F.count("*").alias("n_jobs"))
