"""One-to-one matching by equality: the k-th occurrence of a value on one side pairs with the k-th on the other.

Exact matching of functions is an equi-join on (sorted tokens, occurrence), not a loop over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bags import certain, score


def occurrence(df: DataFrame, keys: list[str], value: str | Column, order: str, name: str = "k") -> DataFrame:
    """df with the rank of each row among those of its keys and value, by position."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, value).orderBy(order)))


def bag_key(tokens: str) -> Column:
    """A bag as a value: its sorted elements."""
    return F.array_sort(F.col(tokens))


#: So many files with one name meet its libraries in one task.
NAME_FILES = 1 << 16


def digest(df: DataFrame, value: str) -> Column:
    """A text or an array of texts as half of its SHA-256, which shuffles and sorts carry in place of the whole; others as they are."""
    kind = df.schema[value].dataType.simpleString()
    if kind not in ("string", "array<string>"):
        return F.col(value)
    whole = F.col(value) if kind == "string" else F.to_json(value)  # JSON keeps elements apart, and nulls among them
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def pair_equal(unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, value: str, index: str = "idx", pairs: DataFrame | None = None) -> DataFrame:
    """(file, lib_key, unknown_idx, lib_idx): one row for each pair of equal values of a file and a library.

    unknown has (file, index, value), lib has (lib_key, index, value), of one type. pairs limits it to candidate (file, lib_key).
    """
    u = occurrence(unknown.select(file, F.col(index).alias("unknown_idx"), digest(unknown, value).alias("v")), [file], "v", "unknown_idx")
    b = occurrence(lib.select(lib_key, F.col(index).alias("lib_idx"), digest(lib, value).alias("v")), [lib_key], "v", "lib_idx")
    if pairs is not None:
        u = u.join(pairs.select(file, lib_key).distinct(), file)
    out = u.join(b, [lib_key, "v", "k"] if pairs is not None else ["v", "k"])
    return out.select(file, lib_key, "unknown_idx", "lib_idx")


def match_scores(mapping: DataFrame, unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, method: str = "v6", pairs: DataFrame | None = None) -> DataFrame:
    """(file, lib_key, num, den, val): v5 is matches over the union, v6 matches over the library's functions.

    With pairs, pairs without a match come too; sizes of absent sides are 0.
    """
    n_u = unknown.groupBy(file).agg(F.count("*").alias("n_u"))
    n_l = lib.groupBy(lib_key).agg(F.count("*").alias("n_l"))
    m = mapping.groupBy(file, lib_key).agg(F.count("*").alias("m"))
    if pairs is not None:
        m = pairs.select(file, lib_key).distinct().join(m, [file, lib_key], "left")
    rows = m.join(n_u, file, "left").join(n_l, lib_key, "left").fillna(0, ["m", "n_u", "n_l"])
    if method == "v5":
        s = score(F.col("m"), F.col("n_u") + F.col("n_l") - F.col("m"), 1.0)
    else:
        s = F.when(F.col("n_u") == 0, score(F.col("m"), F.col("n_l"), 1.0)).otherwise(score(F.col("m"), F.col("n_l"), 0.0))
    return rows.select(file, lib_key, s["num"].alias("num"), s["den"].alias("den"), s["val"].alias("val"))


def first_by_name(df: DataFrame, keys: list[str], name: str = "name", index: str = "idx") -> DataFrame:
    """Distinct names with the first position of each."""
    return df.groupBy(*keys, name).agg(F.min(index).alias(index))


def match_names(unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, method: str = "our", name: str = "name", index: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(mapping, scores) by equal distinct names: jaccard over the union of names, our over the library's names.

    The files of a name that over NAME_FILES have are dealt over several tasks, each with the libraries of that name; there
    are at most as many such names as NAME_FILES goes into the rows of unknown, so they are broadcast.
    """
    u, b = first_by_name(unknown, [file], name, index), first_by_name(lib, [lib_key], name, index)
    many = u.groupBy(name).agg(F.ceil(F.count("*") / NAME_FILES).cast("int").alias("_parts")).filter("_parts > 1")
    dealt = u.withColumnRenamed(index, "unknown_idx").join(F.broadcast(many), name, "left").withColumn("_part", F.pmod(F.xxhash64(file), F.coalesce("_parts", F.lit(1))).cast("int"))
    each = b.withColumnRenamed(index, "lib_idx").join(F.broadcast(many), name, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    mapping = dealt.join(each, [name, "_part"]).select(file, lib_key, "unknown_idx", "lib_idx", certain().alias("prob"))
    return mapping, match_scores(mapping, u, b, file, lib_key, "v5" if method == "jaccard" else "v6")


def match_literals(unknown: DataFrame, lib: DataFrame, file: str, lib_key: str, value: str, index: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(mapping, scores) of literals: bag pairing, score over the union."""
    mapping = pair_equal(unknown, lib, file, lib_key, value, index)
    return mapping.withColumn("prob", certain()), match_scores(mapping, unknown, lib, file, lib_key, "v5")


def invert(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """The mapping the other way round; fails where a library index comes twice."""
    n = F.count("*").over(Window.partitionBy(*keys, "lib_idx"))
    once = F.when(n == 1, F.col("lib_idx")).otherwise(F.raise_error(F.lit("the mapping has a value twice")).cast("int"))
    return mapping.select(*keys, once.alias("unknown_idx"), F.col("unknown_idx").alias("lib_idx"))
