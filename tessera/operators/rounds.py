"""One-to-one assignment in rounds over a table of similar pairs: no task holds the functions of a file or a library.

Each round takes the pairs that nothing can take away any more and drops all others of the functions they pair. What is
left after all rounds is what taking one pair after another gives, ties included: the order of pairs is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import dropped, stored


def similar_pairs(pairs: DataFrame, unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, value: str = "tokens") -> DataFrame:
    """(file, lib_key, u, l, num, den, val) of the functions of candidate pairs whose bags score above 0.

    unknown (file, idx, value) and lib (lib_key, idx, value) meet by an equi-join on elements; empty bags equal one
    another, with a score of 1 that is 0 of 0. A null bag is empty.
    """
    both = pairs.select(file, lib_key).distinct()
    bags = lambda df, key, idx: df.select(key, F.col("idx").alias(idx), F.coalesce(value, F.array().cast(df.schema[value].dataType)).alias("bag"))
    mine, theirs = bags(unknown, file, "u"), bags(lib, lib_key, "l")
    counts = lambda df, key, idx, n: df.select(key, idx, F.explode("bag").alias("v")).groupBy(key, idx, "v").agg(F.count("*").alias(n))
    sizes = lambda df, key, idx, n: df.select(key, idx, F.size("bag").cast("long").alias(n))
    met = counts(mine, file, "u", "a").join(both, file).join(counts(theirs, lib_key, "l", "b"), [lib_key, "v"])
    num = met.groupBy(file, lib_key, "u", "l").agg(F.sum(F.least("a", "b")).alias("num"))
    sized = num.join(sizes(mine, file, "u", "n"), [file, "u"]).join(sizes(theirs, lib_key, "l", "m"), [lib_key, "l"])
    scored = sized.select(file, lib_key, "u", "l", "num", (F.col("n") + F.col("m") - F.col("num")).alias("den"))
    empty = mine.filter(F.size("bag") == 0).select(file, "u").join(both, file).join(theirs.filter(F.size("bag") == 0).select(lib_key, "l"), lib_key)
    scored = scored.unionByName(empty.select(file, lib_key, "u", "l", F.lit(0).cast("long").alias("num"), F.lit(0).cast("long").alias("den")))
    return scored.withColumn("val", F.when(F.col("den") == 0, 1.0).otherwise(F.col("num") / F.col("den")))


def _rounds(pairs: DataFrame, keys: list[str], by_u: list[Column], by_l: list[Column]) -> DataFrame:
    """The pairs that are first of their u by ``by_u`` and first of their l by ``by_l``, round after round."""
    first = lambda side, order: F.row_number().over(Window.partitionBy(*keys, side).orderBy(*order)) == 1
    left, taken = stored(pairs, "pairs"), []
    while not left.isEmpty():
        ranked = left.withColumn("_u", first("u", by_u)).withColumn("_l", first("l", by_l))
        now = stored(ranked.filter("_u and _l").drop("_u", "_l"), "taken")
        taken.append(now)
        rest = left.join(now.select(*keys, "u"), [*keys, "u"], "left_anti").join(now.select(*keys, "l"), [*keys, "l"], "left_anti")
        before, left = left, stored(rest.select(left.columns), "pairs")
        dropped(before)
    dropped(left)
    out = pairs.limit(0)
    for now in taken:
        out = out.unionByName(now)
    return out


def best_first(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The best pair of all of a key, then the best of what is left; ties by u, then l.

    A pair that is the best of both its functions can be taken at once. Pairs come as (keys, u, l, val, ...).
    """
    order = [F.desc("val"), F.col("u"), F.col("l")]
    return _rounds(pairs, keys, order, order)


def in_turn(pairs: DataFrame, keys: list[str], lib_chooses: bool = False) -> DataFrame:
    """Each function of the choosing side, in its order, takes the best one left of the other side; ties go to the lower index.

    The best left of a function is its own for good where no function that chooses before it and is still free could take
    it. Functions choose from what they are similar to, so far apart ones choose in the same round.
    """
    me, other = ("l", "u") if lib_chooses else ("u", "l")
    choice, turn = [F.desc("val"), F.col(other)], [F.col(me)]
    return _rounds(pairs, keys, *((turn, choice) if lib_chooses else (choice, turn)))
