"""Compute a column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Add columns, given as Column or SQL text, that later steps may use many times or filter on.

    A filter on a column made by `select` or `withColumn` is pushed below it with the whole expression copied
    in, once per use. With several layers of regular expressions the copies multiply. A one-row generator
    is not crossed by such filters, stays inside generated code, and costs next to nothing.
    """
    keep = [f"`{c}`" for c in df.columns if c not in columns]
    fields = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    return df.select(*keep, F.inline(F.array(F.struct(*fields))))
