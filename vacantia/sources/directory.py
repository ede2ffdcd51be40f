"""The company directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vacantia.functions.rules import shard_index
from vacantia.functions.text import empty_to_null

_PAGE = (
    "hits ARRAY<STRUCT<slug: STRING, objectID: STRING, name: STRING, website: STRING, batch: STRING, isHiring: BOOLEAN>>, "
    "nbPages INT"
)


_BROKEN = "broken"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured directory pages as JSON Lines of {dir_page, hits, nbPages}; `broken` holds a line that is no such page."""
    schema = T.StructType([T.StructField("dir_page", T.IntegerType()), *T.StructType.fromDDL(_PAGE).fields, T.StructField(_BROKEN, T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", _BROKEN).json(path)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """The same from captured bodies (dir_page, body)."""
    p = F.from_json("body", f"{_PAGE}, {_BROKEN} STRING", {"columnNameOfCorruptRecord": _BROKEN})
    broken = F.when(F.col("body").isNull() | F.col("p").isNull(), F.lit("")).otherwise(F.col(f"p.{_BROKEN}"))
    return pages.select("dir_page", "body", p.alias("p")).select("dir_page", "p.hits", "p.nbPages", broken.alias(_BROKEN))


def read_directory_pages(spark: SparkSession, path: str) -> DataFrame:
    """Companies of captured directory pages in JSON Lines."""
    return companies_from_hits(read_pages(spark, path))


def companies_from_pages(pages: DataFrame) -> DataFrame:
    """Companies from captured directory pages (dir_page, body)."""
    return companies_from_hits(parsed_pages(pages))


def _last_page(pages: DataFrame) -> Column:
    """Number of the first readable page whose successor is not below its nbPages; a missing nbPages means 0."""
    last = pages.where(F.col(_BROKEN).isNull() & (F.col("dir_page") + 1 >= F.coalesce("nbPages", F.lit(0)))).agg(F.min("dir_page"))
    return F.coalesce(last.scalar(), F.lit(2**31 - 1))


def companies_from_hits(pages: DataFrame) -> DataFrame:
    """Companies of the pages up to the last one. A page that cannot be read does not end the walk; see `directory_faults`."""
    walked = pages.where(F.col(_BROKEN).isNull() & (F.col("dir_page") <= _last_page(pages)))
    return walked.select("dir_page", F.posexplode("hits").alias("pos", "h")).select(
        "dir_page", "pos", "h.slug", F.col("h.objectID").alias("object_id"), "h.name", "h.website", "h.batch",
        F.col("h.isHiring").alias("is_hiring"),
    )


def directory_faults(pages: DataFrame) -> DataFrame:
    """(dir_page, fault) of the pages before the end of the directory that are malformed or were never captured.

    Takes the tables of `read_pages` or `parsed_pages`. Pages are few: one per hundred companies.
    """
    known = pages.groupBy("dir_page").agg(F.max(F.col(_BROKEN).isNull()).alias("readable"))
    told = F.least(_last_page(pages), F.coalesce(pages.agg(F.max("nbPages") - 1).scalar(), F.lit(0)))
    spark = pages.sparkSession
    all_pages = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.greatest(told, F.lit(0)))).alias("dir_page"))
    missing = all_pages.join(known, "dir_page", "left_anti").select("dir_page", F.lit("directory page was not captured").alias("fault"))
    return known.where("NOT readable").select("dir_page", F.lit("directory page is malformed").alias("fault")).unionByName(missing)


def shard_key() -> Column:
    return F.coalesce(empty_to_null(F.col("slug")), F.col("object_id"), F.lit(""))


def with_shard(companies: DataFrame, num_shards: int) -> DataFrame:
    return companies.withColumn("shard", shard_index(shard_key(), num_shards))


def select_companies(
    companies: DataFrame,
    *,
    only_hiring: bool = True,
    max_companies: int = 0,
    num_shards: int = 1,
    shard: int | None = None,
    limit_per_shard: bool = False,
) -> DataFrame:
    """Companies of a run, with their shard.

    `shard=None` keeps all shards in one run. `max_companies` (0 = all) takes the first ones in directory
    order, over the whole run or for each shard.
    """
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
    if shard is not None and not 0 <= shard < num_shards:
        raise ValueError("shard must satisfy 0 <= shard < num_shards")
    if max_companies < 0:
        raise ValueError("max_companies must not be negative")
    df = companies.where("is_hiring") if only_hiring else companies
    df = with_shard(df, num_shards)
    if shard is not None:
        df = df.where(F.col("shard") == shard)
    if not max_companies:
        return df
    order = [F.col("dir_page"), F.col("pos")]
    if limit_per_shard and num_shards > 1 and shard is None:
        # Each map task keeps only its own first N rows per shard before the shuffle.
        rank = F.row_number().over(Window.partitionBy("shard").orderBy(*order))
        return df.withColumn("_n", rank).where(F.col("_n") <= max_companies).drop("_n")
    return df.orderBy(*order).limit(max_companies)
