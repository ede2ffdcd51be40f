"""Connected components of a table of links, named by their smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.session import stage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b); loops count as ids of their own.

    Each round hooks every id to its smallest neighbour, follows the hooks to their ends and replaces the ids of the
    links by those ends, so links shrink fast. Hooks only lead to smaller ids; the last one left is the smallest. Each
    round is written, so a lost executor costs one round at most.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    named = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    edges = edges.where("a < b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = stage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("to")), "hooks")
        while True:
            ends = hooks.select(F.col("id").alias("to"), F.col("to").alias("end"))
            jumped = stage(hooks.join(ends, "to").select("id", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "hooks")
            hooks = jumped.select("id", "to")
            if jumped.where("moved").isEmpty():
                break
        named = stage(named.join(hooks.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")), "named")
        left, right = hooks.toDF("a", "x"), hooks.toDF("b", "y")
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return named
