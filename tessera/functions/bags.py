"""Set and bag similarity on array columns: built-in higher-order functions only.

Bags are arrays in which repeats count; equality is that of the element type, and NaN equals NaN (pass numbers=True for
numeric bags in which NaN matches nothing). Null arrays give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score(num: Column, den: Column, empty: float) -> Column:
    """{val, num, den}; ``empty`` is the value of 0/0."""
    val = F.when(den == 0, F.lit(empty)).otherwise(num / F.when(den != 0, den))
    return F.struct(val.cast("double").alias("val"), num.cast("long").alias("num"), den.cast("long").alias("den"))


def certain() -> Column:
    """The score that isn't computed."""
    return F.struct(F.lit(1.0).alias("val"), F.lit(-1).cast("long").alias("num"), F.lit(-1).cast("long").alias("den"))


def without_null(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def without_falsy(a: Column) -> Column:
    """Texts that aren't null or empty."""
    return F.filter(a, lambda v: v.isNotNull() & (v != ""))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def set_jaccard(a: Column, b: Column) -> Column:
    return score(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 1.0)


def set_portion(lib: Column, unknown: Column) -> Column:
    """Share of the library's set; the library comes first. An empty library gives 1 for an empty unknown, else 0."""
    num, den = F.size(F.array_intersect(lib, unknown)), F.size(F.array_distinct(lib))
    return F.when(F.size(unknown) == 0, score(num, den, 1.0)).otherwise(score(num, den, 0.0))


def occurrences(a: Column) -> Column:
    """Each element with its rank among its equals, as structs (v, k): two bags become two sets, k-th pairs with k-th.

    Sorted first, so that one pass numbers the runs.
    """
    empty = F.struct(F.slice(F.transform(a, lambda v: F.struct(v.alias("v"), F.lit(0).alias("k"))), 1, 0).alias("out"), F.lit(0).alias("k"), F.element_at(a, 1).alias("last"))

    def step(acc, v):
        k = F.when(v.eqNullSafe(acc["last"]), acc["k"] + 1).otherwise(1)
        return F.struct(F.concat(acc["out"], F.array(F.struct(v.alias("v"), k.alias("k")))).alias("out"), k.alias("k"), v.alias("last"))

    # try_element_at: an empty bag has no first element.
    empty = empty.withField("last", F.try_element_at(a, F.lit(1)))
    return F.aggregate(F.array_sort(a), empty, step, lambda acc: acc["out"])


def bag_common(a: Column, b: Column, numbers: bool = False) -> Column:
    """Size of the bag intersection: the sum over values of the smaller count."""
    if numbers:
        a, b = (F.filter(x, lambda v: ~F.isnan(v)) for x in (a, b))
    count = lambda x, v: F.size(F.filter(x, lambda w: w.eqNullSafe(v)))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)))


def bag_jaccard(a: Column, b: Column, numbers: bool = False) -> Column:
    num = bag_common(a, b, numbers)
    return score(num, F.size(a) + F.size(b) - num, 1.0)


def lib_portion(unknown: Column, lib: Column) -> Column:
    """Bag intersection over the library's size; an empty library gives 1 for an empty unknown, else 0."""
    num, den = bag_common(unknown, lib), F.size(lib)
    return F.when(F.size(unknown) == 0, score(num, den, 1.0)).otherwise(score(num, den, 0.0))


def lib_portion_indexes(unknown: Column, lib: Column) -> Column:
    """lib_portion of indexes; -1 in unknown stands for no match, but counts as an element of unknown."""
    num, den = bag_common(F.filter(unknown, lambda v: v != -1), lib), F.size(lib)
    return F.when(F.size(unknown) == 0, score(num, den, 1.0)).otherwise(score(num, den, 0.0))


def _keep(a: Column, b: Column, common: bool) -> Column:
    """Elements of a, in order, whose rank among their equals is (common) or isn't within b's count."""
    indexed = F.transform(a, lambda v, i: F.struct(v.alias("v"), F.size(F.filter(F.slice(a, 1, i + 1), lambda w: w.eqNullSafe(v))).alias("k")))
    inside = lambda e: e["k"] <= F.size(F.filter(b, lambda w: w.eqNullSafe(e["v"])))
    return F.transform(F.filter(indexed, lambda e: inside(e) if common else ~inside(e)), lambda e: e["v"])


def repeated_intersection(a: Column, b: Column) -> Column:
    return _keep(a, b, True)


def repeated_difference(a: Column, b: Column) -> Column:
    return _keep(a, b, False)


def repeated_ops(a: Column, b: Column) -> Column:
    """{i, d, rd}: bag intersection, a without b, b without a."""
    return F.struct(_keep(a, b, True).alias("i"), _keep(a, b, False).alias("d"), _keep(b, a, False).alias("rd"))


def add_missing(x: Column, y: Column) -> Column:
    """x, then the elements of y that x lacks; repeats within y stay."""
    return F.concat(x, F.filter(y, lambda v: ~F.array_contains(x, v)))


def zip_apply(f, *arrays: Column) -> Column:
    """f over elements at the same position, for any number of arrays."""
    return F.transform(F.arrays_zip(*arrays), lambda s: f(*[s[str(i)] for i in range(len(arrays))])) if len(arrays) != 2 else F.zip_with(*arrays, f)


def pairs_of(a: Column, b: Column) -> Column:
    """(i, j) positions: each element of a with the first unused equal one of b."""
    rank = lambda x: F.transform(x, lambda v, i: F.struct(v.alias("v"), F.size(F.filter(F.slice(x, 1, i + 1), lambda w: w.eqNullSafe(v))).alias("k")))
    # One element that holds both sides, so that each is ranked once and not for each element of the other.
    both = F.array(F.struct(rank(a).alias("a"), rank(b).alias("b")))
    found = F.transform(both, lambda s: F.transform(s["a"], lambda e, i: F.struct(i.alias("i"), (F.array_position(s["b"], e) - 1).cast("int").alias("j"))))
    return F.filter(found[0], lambda p: p["j"] >= 0)


def invert_pairs(pairs: Column) -> Column:
    """(j, i) sorted by j; a repeated j raises, as a mapping that isn't one to one has no inverse."""
    out = F.array_sort(F.transform(pairs, lambda p: F.struct(p["j"].alias("i"), p["i"].alias("j"))))
    unique = F.size(F.array_distinct(F.transform(pairs, lambda p: p["j"]))) == F.size(pairs)
    return F.when(unique, out).otherwise(F.raise_error(F.lit("the mapping has a value twice")).cast("array<struct<i:int,j:int>>"))


def reduced(num: Column, den: Column) -> Column:
    """The fraction num/den in lowest terms (den 0 counts as 1), by Euclid's steps on longs."""
    den = F.when(den == 0, F.lit(1)).otherwise(den).cast("long")
    start = F.struct(F.abs(num.cast("long")).alias("a"), den.alias("b"))
    step = lambda acc, _: F.struct(F.when(acc["b"] == 0, acc["a"]).otherwise(acc["b"]).alias("a"), F.when(acc["b"] == 0, F.lit(0).cast("long")).otherwise(acc["a"] % F.when(acc["b"] == 0, F.lit(1).cast("long")).otherwise(acc["b"])).alias("b"))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda acc: F.greatest(acc["a"], F.lit(1).cast("long")))
    whole = lambda x: F.floor(x / g).cast("long")
    return F.struct(whole(num.cast("long")).alias("num"), whole(den).alias("den"))


def first_position(a: Column, v: Column) -> Column:
    """Position of the first equal element, from 0; -1 if there is none."""
    return (F.array_position(a, v) - 1).cast("int")


def last_position(a: Column, v: Column) -> Column:
    """Position of the last equal element, from 0; -1 if there is none."""
    back = F.array_position(F.reverse(a), v)
    return F.when(back > 0, F.size(a) - back).otherwise(-1).cast("int")


def chunks(a: Column, size: int) -> Column:
    """The array cut into pieces of a length, the last one shorter; an empty array gives none."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, size))
