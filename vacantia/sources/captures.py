"""The response archive: captured HTTP and rendered responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import vocabulary as V
from vacantia.operators.boards import is_board_api
from vacantia.schemas import RESPONSES, carried

CAPTURE = ["request_url", "render", "fetched_at"]

def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Archive stored as Parquet. Sort it by request_url when writing, so address filters skip row groups."""
    return spark.read.schema(RESPONSES).parquet(path)


def latest_captures(responses: DataFrame, *more: str) -> DataFrame:
    """Newest capture per (request_url, render) without its body, with the columns `more` if named.

    Reads the narrow columns only. The maximum is taken per map task first, so an address captured very
    often does not load one task.
    """
    facts = F.struct("final_url", "status", "content_type", "error", *more)
    return (
        responses.groupBy("request_url", "render")
        .agg(F.max("fetched_at").alias("fetched_at"), F.max_by(facts, F.col("fetched_at")).alias("c"))
        .select("request_url", "render", "fetched_at", "c.*")
    )


def page_captures(responses: DataFrame) -> DataFrame:
    """Captures usable as pages: status 200, or any rendered body. API payloads are left out."""
    usable = ((F.col("render") == "http") & (F.col("status") == 200)) | (F.col("render") == "browser")
    return responses.where(
        usable & F.col("error").isNull() & F.col("body").isNotNull() & ~is_board_api(F.col("request_url"))
        & ~(F.col("request_url").startswith(V.LISTINGS_PAGE[0]) & F.col("request_url").endswith(V.LISTINGS_PAGE[1]))
    ).select("request_url", "render", "fetched_at", "final_url", "body", *carried(responses))
