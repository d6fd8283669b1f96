"""Bounded top-k and version order, with explicit tie keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "top") -> DataFrame:
    """The first k rows of each key. Spark keeps k rows of a key in each task before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def global_top_k(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def version_order(df: DataFrame, key: str, order: list[str], name: str = "pos") -> DataFrame:
    """Rank of each version of a key: from the one at nine tenths outwards, one back, then one forward."""
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(*order)) - 1
    start = F.floor((F.count("*").over(w) - 1) * 9 / 10)
    d = df.withColumn("_d", at - start)
    return d.withColumn(name, F.row_number().over(w.orderBy(F.abs("_d"), F.col("_d") > 0))).drop("_d")


def until_first(df: DataFrame, keys: list[str], order: str, found: Column) -> DataFrame:
    """Rows up to and including the first one where found holds: what an early stop would have seen."""
    before = F.sum(found.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", F.coalesce(before, F.lit(0))).filter("_before = 0").drop("_before")


def top_of_top(df: DataFrame, key: str, order: list[Column | str], each: int = 25, total: int = 100) -> DataFrame:
    """The best rows of each key, then the best of those."""
    return global_top_k(top_k(df, [key], order, each, "_each").drop("_each"), order, total)
