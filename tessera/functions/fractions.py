"""Exact sums and means of fractions: counts by denominator are summed as integers, then folded in arbitrary precision."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An exact fraction in lowest terms, as text since its numbers may be of any size, and the double next to it.
EXACT = "num string, den string, val double"
LONG = 1 << 63


def folded(terms: list[tuple[int, int]]) -> Fraction:
    """The sum of num/den over (num, den), halves first, so that the common denominator grows as late as it can; den 0 is 1/1."""
    parts = [Fraction(int(n), int(d)) for n, d in terms]
    while len(parts) > 1:
        parts = [sum(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else Fraction(0)


def _shown(x: Fraction) -> tuple[str, str, float]:
    return str(x.numerator), str(x.denominator), x.numerator / x.denominator


def _mean(terms: pd.Series, count: pd.Series) -> pd.DataFrame:
    found = [_shown(folded([(t["num"], t["den"]) for t in some]) / int(n)) for some, n in zip(terms, count, strict=True)]
    return pd.DataFrame(found, columns=["num", "den", "val"])


def mean_fractions(df: DataFrame, keys: list[str], num: str = "num", den: str = "den") -> DataFrame:
    """(keys, num, den, val): the exact mean of the fractions of each key, in lowest terms.

    A fraction with denominator 0 counts as 1, one with a null part not at all. Numerators of equal denominators are
    summed in the tasks that read them and after the shuffle, so what is folded for a key is a row for each distinct
    denominator (the size of a bag, say), however many fractions it has.
    """
    whole = F.col(den) == 0
    terms = df.filter(F.col(num).isNotNull() & F.col(den).isNotNull()).select(*keys, F.when(whole, 1).otherwise(F.col(num)).cast("long").alias("_num"), F.when(whole, 1).otherwise(F.col(den)).cast("long").alias("_den"))
    sums = terms.groupBy(*keys, "_den").agg(F.sum(F.col("_num").cast("decimal(38,0)")).alias("_num"), F.count("*").alias("_n"))
    each = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_num").cast("string").alias("num"), F.col("_den").alias("den"))).alias("_terms"), F.sum("_n").alias("_n"))
    return each.select(*keys, F.pandas_udf(_mean, EXACT)("_terms", "_n").alias("_mean")).select(*keys, "_mean.num", "_mean.den", "_mean.val")


def _times(num: pd.Series, den: pd.Series, by: pd.Series, of: pd.Series) -> pd.DataFrame:
    found = []
    for a, b, c, d in zip(num, den, by, of, strict=True):
        x = Fraction(int(a), int(b)) * (Fraction(int(c), int(d)) if c is not None else 1) if b else None
        fits = x is not None and max(x.numerator, x.denominator) < LONG
        found.append((0, 0, None) if x is None else (x.numerator if fits else None, x.denominator if fits else None, x.numerator / x.denominator))
    return pd.DataFrame(found, columns=["num", "den", "val"]).astype({"num": "Int64", "den": "Int64"})


def times(num: Column, den: Column, by: Column, of: Column) -> Column:
    """The product of num/den with by/of (texts, as ``mean_fractions`` gives them; null is 1) as {num, den, val} in lowest terms.

    Of a den of 0 it is 0/0 without a value; numbers beyond a long are null, with their value.
    """
    return F.pandas_udf(_times, "num bigint, den bigint, val double")(num, den, by, of)
