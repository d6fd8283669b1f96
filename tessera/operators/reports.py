"""Grouped reports: counts, matrices, precision and recall, dedup and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num / F.when(den != 0, den))


def location_report(files: DataFrame, keys: list[str], has_candidates: Column) -> DataFrame:
    """Per app: files, files without candidates, both by location as maps."""
    per = files.withColumn("_none", ~has_candidates).groupBy(*keys, "location").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_none"), F.col("id")))).alias("ids"))
    entries = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("location", v))))
    return per.groupBy(*keys).agg(F.sum("n").alias("total_files"), F.sum(F.size("ids")).alias("no_candidates"), entries("n").alias("total_per_location"), entries("ids").alias("no_candidates_per_location"))


def histogram(df: DataFrame, label: str, values: tuple[str, ...]) -> DataFrame:
    """One row: the count of each label and the total."""
    return df.agg(*[F.count_if(F.col(label) == v).alias(v) for v in values], F.count("*").alias("total"))


def status(pool: DataFrame, preprocessed: DataFrame, analysed: DataFrame, kind: str) -> DataFrame:
    """(kind, all, preprocessed, analysed) counts, of every kind that any of them has."""
    parts = [d.groupBy(kind).agg(F.count("*").alias(n)) for d, n in ((pool, "all"), (preprocessed, "preprocessed"), (analysed, "analysed"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, kind, "full")
    return out.fillna(0, ["all", "preprocessed", "analysed"])


def presence_matrix(df: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """0/1 for each row and each of the columns given. The list is the caller's, so its length bounds the plan."""
    flags = [F.max((F.col(column) == c).cast("int")).alias(c) for c in columns]
    return df.groupBy(row).agg(*flags).fillna(0)


def presence_pairs(rows: DataFrame, columns: DataFrame, present: DataFrame, row: str, column: str) -> DataFrame:
    """The same as long rows, where there are too many columns for a plan: every pair with whether it's present."""
    return rows.select(row).distinct().join(columns.select(column).distinct()).join(present.select(row, column).distinct().withColumn("present", F.lit(1)), [row, column], "left").fillna(0, ["present"])


def mention_counts(mentions: DataFrame) -> DataFrame:
    """(name, n, versions): versions in the order first seen, names by count."""
    each = mentions.groupBy("name", "version").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    out = each.groupBy("name").agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("first", "version"))), lambda s: s["version"]).alias("versions"))
    return out.orderBy(F.desc("n"), "name")


def precision_recall(df: DataFrame, correct: Column, claimed: Column, truth: int) -> DataFrame:
    out = df.agg(F.count_if(correct).alias("correct"), F.count_if(claimed).alias("claimed"))
    return out.withColumns({"precision": ratio(F.col("correct"), F.col("claimed")), "recall": ratio(F.col("correct"), F.lit(truth))})


#: What a verified detection can be, and how many names, and names with versions, were to be found.
DETECTIONS, TRUE_NAMES, TRUE_VERSIONS = ("non-guess", "incorrect-version", "false-match"), 17, 15


def method_precision_recall(df: DataFrame, method: str, kind: str, names: int = TRUE_NAMES, versions: int = TRUE_VERSIONS) -> DataFrame:
    """(method, of, precision_num, precision_den, precision, recall_num, recall_den, recall): two rows for each method.

    A wrong version counts for ``of`` = names, not for names-versions; other kinds than DETECTIONS count for nothing.
    """
    good, late, wrong = (F.count_if(F.col(kind) == k) for k in DETECTIONS)
    each = df.groupBy(method).agg(good.alias("_g"), late.alias("_l"), wrong.alias("_w"))
    both = F.array(*[F.struct(F.lit(of).alias("of"), num.alias("num"), F.lit(truth).cast("long").alias("truth")) for of, num, truth in (("names", F.col("_g") + F.col("_l"), names), ("names-versions", F.col("_g"), versions))])
    rows = each.select(method, (F.col("_g") + F.col("_l") + F.col("_w")).alias("precision_den"), F.explode(both).alias("r"))
    num = F.col("r.num")
    return rows.select(
        method, F.col("r.of").alias("of"), num.alias("precision_num"), "precision_den", ratio(num, F.col("precision_den")).alias("precision"),
        num.alias("recall_num"), F.col("r.truth").alias("recall_den"), ratio(num, F.col("r.truth")).alias("recall"),
    )


def detection_ratios(df: DataFrame, found: str = "found") -> DataFrame:
    """Shares of top, secondary, either and missed; no rows give 0."""
    n = F.count("*")
    share = lambda c, name: ratio(F.count_if(c), n).alias(name)
    f = F.col(found)
    return df.agg(share(f == "top", "top"), share(f == "secondary", "secondary"), share(f != "missed", "detected"), share(f == "missed", "missed"))


def first_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value of the first row, conflict: whether other values came later)."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value), (F.count_distinct(value) > 1).alias("conflict"))


def range_union(vulns: DataFrame) -> DataFrame:
    """(name, range): all vulnerable ranges of a name as alternatives."""
    return vulns.select("name", F.explode("ranges").alias("r")).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("r")), " || ").alias("range"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Partial results put together, repeats once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


def by_phase(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Per app: exact, partial and exact-or-partial library versions, from each entry's best match."""
    best = ranked.filter("match = 1").withColumn("lv", F.concat_ws("@", "lib", "version"))
    take = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("lv"))))
    return best.groupBy(*keys).agg(take(F.col("phase") == "rank").alias("exact"), take(F.col("phase") == "secondary").alias("partial"), take(F.lit(True)).alias("ex_part"))


def drawn(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows without replacement, the same ones for a seed: the smallest hashes. Spark keeps n rows in each task."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


#: Runs of values in which ``slices`` ranks rows.
RUNS = 64


def slices(df: DataFrame, order: str, n: int) -> DataFrame:
    """df with ``slice``: n ranges of equal length in the order of a column of numbers, dates or times; nulls come first.

    Rows are ranked within RUNS runs of values of about equal length; the runs' counts give each the rows before it, so
    no task sorts the whole. df must give the same rows when it is read again.
    """
    cuts = df.agg(F.percentile_approx(order, [i / RUNS for i in range(1, RUNS)], 10000)).first()[0]
    run = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_run", run)
    found = dict(rows.groupBy("_run").count().collect())
    before = F.element_at(F.array(*[F.lit(sum(k for r, k in found.items() if r < i)).cast("long") for i in range(RUNS)]), F.col("_run") + 1)
    each = -(-sum(found.values()) // n) or 1
    place = before + F.row_number().over(Window.partitionBy("_run").orderBy(order)) - 1
    return rows.withColumn("slice", F.floor(place / each)).drop("_run")


def in_locale_order(df: DataFrame, name: str, place: str = "place", collation: str = "UNICODE") -> DataFrame:
    """(name, place) of distinct names, numbered from 1 on in a locale's order: letters before case, by Spark's collation.

    Names are cut into RUNS runs in that order; a run is numbered by itself, after the names of the runs before it.
    """
    names = df.select(F.collate(name, collation).alias("_name"), name).distinct()
    runs = stored(names.repartitionByRange(RUNS, "_name").select(name, F.spark_partition_id().alias("_run")), "runs").withColumn("_name", F.collate(name, collation))
    counts = runs.groupBy("_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.join(F.broadcast(counts.select("_run", before.alias("_before"))), "_run")  # RUNS rows
    return placed.select(name, (F.col("_before") + F.row_number().over(Window.partitionBy("_run").orderBy("_name", name))).cast("int").alias(place))


def exact_matches(results: DataFrame, method: str, parts: list[str]) -> DataFrame:
    """(method, matches): the encoded places where a method scored 1."""
    return results.filter("val = 1").groupBy(method).agg(F.array_sort(F.collect_set(F.concat_ws("/", *parts))).alias("matches"))


def function_evaluation(truth: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ratios over hand-checked functions, each expected to be 1.

    truth: (keys, fn_index, lib_index, target, reason), target true for a function that matches, else with the reason
    why not. mapping: (keys, unknown_idx, lib_idx). matched: targets that the mapping pairs as they should be; apart:
    others that it doesn't pair; gone: of those, the ones whose function is gone.
    """
    pairs = mapping.select(*keys, F.col("unknown_idx").alias("fn_index"), F.col("lib_idx").alias("lib_index")).distinct().withColumn("_hit", F.lit(True))
    rows = truth.join(pairs, [*keys, "fn_index", "lib_index"], "left")
    hit, target = F.coalesce("_hit", F.lit(False)), F.coalesce("target", F.lit(False))
    share = lambda good, of, name: ratio(F.count_if(of & good), F.count_if(of), 1.0).alias(name)
    return rows.agg(share(hit, target, "matched"), share(~hit, ~target, "apart"), share(~hit, ~target & (F.col("reason") == "gone"), "gone"))


def library_evaluation(scores: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(exact, empty, total): targets of the truth that score 1, and those whose library has no functions."""
    rows = truth.select(*keys).distinct().join(scores, keys, "left")
    return rows.agg(F.count_if((F.col("val") == 1) & (F.col("den") > 0)).alias("exact"), F.count_if(F.col("den") == 0).alias("empty"), F.count("*").alias("total"))
