"""First-wins merge of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import not_blank, strip

# Order in which postings are met: page, extractor, then the position inside the extractor.
ORDER = ["page_rank", "extractor", "script_pos", "token", "walk_pos"]


def posting_key(job: Column) -> Column:
    """Address of a posting; without one, source and title."""
    url = job["url"]
    named = F.concat_ws(":", F.coalesce(job["source"], F.lit("None")), F.coalesce(job["title"], F.lit("None")))
    return F.when(not_blank(url), strip(url)).otherwise(named)


def merge_postings(postings: DataFrame, group: list[str], carry: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """First posting per group and key.

    "First" is associative and every extractor's own duplicate rule refines this key, so one aggregation
    replaces the stepwise merges. Each task reduces its rows before the shuffle, and the shuffle is by
    (group, key): one group with a third of all rows spreads over all tasks.
    """
    carry = carry or []
    first = F.min_by(F.struct("job", *carry), F.struct(*(order or ORDER)))
    return (
        postings.withColumn("key", posting_key(F.col("job")))
        .groupBy(*group, "key")
        .agg(first.alias("m"))
        .select(*group, "key", "m.*")
    )
