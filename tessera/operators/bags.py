"""Bag and set operators on long tables: (group, value) rows, one for each occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bags import score


def counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the count table of bags; shuffles partial counts only."""
    return df.groupBy(key, value).agg(F.count("*").alias("n"))


def bag_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str) -> DataFrame:
    """(left_key, right_key, num, n_left, n_right) of all pairs of bags that share a value; pairs of empty bags share none.

    left and right are count tables with a key each. Sizes are joined to the pairs, which are far fewer than the values;
    the count tables' exchanges are reused for them.
    """
    num = left.withColumnRenamed("n", "_a").join(right.withColumnRenamed("n", "_b"), value).groupBy(left_key, right_key).agg(F.sum(F.least("_a", "_b")).cast("long").alias("num"))
    n_left = left.groupBy(left_key).agg(F.sum("n").cast("long").alias("n_left"))
    n_right = right.groupBy(right_key).agg(F.sum("n").cast("long").alias("n_right"))
    return num.join(n_left, left_key).join(n_right, right_key).select(left_key, right_key, "num", "n_left", "n_right")


def scored(overlap: DataFrame, kind: str) -> DataFrame:
    """val, num and den of an overlap table: jaccard, or portion of the right side."""
    den = F.col("n_left") + F.col("n_right") - F.col("num") if kind == "jaccard" else F.col("n_right")
    s = score(F.col("num"), den, 1.0)
    keep = [c for c in overlap.columns if c not in ("num", "n_left", "n_right")]
    return overlap.select(*keep, s["num"].alias("num"), s["den"].alias("den"), s["val"].alias("val"))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def containment(overlap: DataFrame) -> DataFrame:
    """Pairs whose left set is within the right one (set count tables have n = 1): relational division."""
    return overlap.filter(F.col("num") == F.col("n_left"))


def weighted_mean(mapping: DataFrame, key: str, num: str = "num", den: str = "den") -> DataFrame:
    """(key, mean) of the fractions; exact in each term, averaged in double precision."""
    return mapping.groupBy(key).agg(F.avg(F.when(F.col(den) == 0, F.lit(1.0)).otherwise(F.col(num) / F.col(den))).alias("mean"))
