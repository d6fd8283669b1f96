"""Candidate libraries of a file from its literals: all that contain them, else the most similar ones.

Where the libraries' distinct literals fit a checked bound, they go to the tasks as an inverted index. Beyond the bound,
blocks of libraries of that size meet groups of files, each in a task of its own. Either way a file's postings are read
from the rarest literal on, only as far as a library not yet seen can still enter the best, and only what can be kept
leaves the task: pairs never become a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.bags import bag_overlap, counts, scored
from tessera.operators.pairing import digest
from tessera.operators.topk import top_k

#: Candidates kept for a file, for a bundle, and without a limit given.
PER_FILE, PER_BUNDLE, DEFAULT_LIMIT = 10, 50, 100
#: Distinct (library, literal) rows up to which the index is sent to the tasks; also those of a block, and the files that meet it.
INDEX_ROWS, GROUP_FILES = 1 << 22, 1 << 14
#: Postings of a file that are read at once without looking for an end.
FEW = 4096


def set_similarity(files: DataFrame, libs: DataFrame, file: str, lib: str, value: str) -> DataFrame:
    """(file, lib, num, n_left, n_right) of all pairs of literal sets that share a literal."""
    return bag_overlap(counts(files.select(file, value).distinct(), file, value), counts(libs.select(lib, value).distinct(), lib, value), file, lib, value)


class Postings:
    """The libraries of each literal, as numbers in the order of the libraries' ids."""

    def __init__(self, rows: pa.Table):
        self.libs = pc.unique(rows.column(0).combine_chunks()).sort()
        number = pc.index_in(rows.column(0).combine_chunks(), self.libs).to_numpy()
        self.sizes = np.bincount(number, minlength=len(self.libs))
        coded = rows.column(1).combine_chunks().dictionary_encode(null_encoding="encode")
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        self.number = number[order]
        self.cuts = np.r_[0, np.cumsum(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))]
        self.values = coded.dictionary
        self.places: dict | None = None

    def _lists(self, values: list) -> list[np.ndarray]:
        """Postings of the known ones of distinct values, the shortest first."""
        if self.places is None:
            self.places = {v: i for i, v in enumerate(self.values.to_pylist()) if v is not None}
        at = sorted((i for v in values if (i := self.places.get(v)) is not None), key=lambda i: (self.cuts[i + 1] - self.cuts[i], i))
        return [self.number[self.cuts[i] : self.cuts[i + 1]] for i in at]

    def shared(self, values: list) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the libraries that share one of the distinct values, how many they share)."""
        lists = self._lists(values)
        return np.unique(np.concatenate(lists), return_counts=True) if lists else (np.zeros(0, np.int64),) * 2

    def best(self, values: list, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``shared``, without libraries that neither hold all n values nor can be among the k most similar.

        Lists are read from the shortest on. The k-th of the similarities that are reached for certain is a threshold
        that rises; once a library in none of the lists read can't reach it, the longer lists are only read for those
        known, and of these only for the ones that still can.
        """
        lists = self._lists(values)
        m = len(lists)
        if sum(map(len, lists)) <= FEW:
            return self.shared(values)
        read, floor = 1, 0.0
        while True:
            libs, count = np.unique(np.concatenate(lists[:read]), return_counts=True)
            sizes = self.sizes[libs]
            if len(libs) >= k:
                floor = np.partition(count / (n + sizes - count), -k)[-k]
            if read == m or (m - read) / n < floor:
                break
            read = min(m, 2 * read)
        most = np.minimum(count + m - read, sizes)
        stay = most / (n + sizes - most) >= floor - 1e-12
        if m == n:
            stay |= count == read  # these may hold all values
        libs, count = libs[stay], count[stay]
        for more in lists[read:] if len(libs) else ():
            at = np.minimum(np.searchsorted(libs, more), len(libs) - 1)
            count += np.bincount(at[libs[at] == more], minlength=len(libs))
        return libs, count


def _index(libs: DataFrame, lib: str, value: str, most: int) -> Postings | None:
    rows = libs.select(lib, value).distinct()
    return Postings(rows.toArrow()) if rows.limit(most + 1).count() <= most else None


def _sets(files: DataFrame, file: str, value: str) -> DataFrame:
    """(file, values, n): distinct literals, nulls apart, and their number; partial sets are combined before the shuffle."""
    found = files.groupBy(file).agg(F.collect_set(value).alias("values"), F.max(F.col(value).isNull().cast("int")).alias("null"))
    return found.select(file, "values", (F.size("values") + F.col("null")).alias("n"))


def _kept(index: Postings, sets: DataFrame, file: str, lib: str, look, keep) -> DataFrame:
    """(file, lib, num, den, val, top) of what ``keep`` chooses of what ``look`` finds: a function of (files, numbers, num, n) of a batch, flat."""
    sent = sets.sparkSession.sparkContext.broadcast(index)
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema.fields}

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                each = [look(sent.value, v, n) for v, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                rows = np.repeat(np.arange(part.num_rows), [len(x) for x, _ in each])
                number, num = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in each)]) for k in (0, 1))
                rows, number, num, den, val, top = keep(sent.value, rows, number.astype(np.int64), num.astype(np.int64), part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), sent.value.libs.take(pa.array(number)), *map(pa.array, (num, den, val)), pa.array(top.astype(np.int32))], [file, lib, "num", "den", "val", "top"])

    lib_kind = {"int64": "bigint", "int32": "int"}.get(str(index.libs.type), "string")
    return sets.mapInArrow(run, f"`{file}` {kinds[file]}, `{lib}` {lib_kind}, num bigint, den bigint, val double, top int")


def _ranks(group: np.ndarray) -> np.ndarray:
    """Places from 1 on within runs of equal values."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    return np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)])) + 1


def candidate_libs(files: DataFrame, libs: DataFrame, file: str, lib: str, value: str, limit: int = DEFAULT_LIMIT, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(file, lib, val, num, den, top). A file that libraries contain gets all of those, with the certain score; others
    get the limit's most similar ones, ties by library. Files without literals get none."""
    index, best = _index(libs, lib, value, index_rows), lambda own, values, n: own.best(values, n, limit)
    if index is None:
        return _decided(_blocks(_sets(files, file, value), libs, file, lib, value, best, index_rows), file, lib, limit)

    def keep(own: Postings, rows, number, num, n):
        inside = num == n[rows]
        whole = np.bincount(rows, weights=inside, minlength=len(n))[rows] > 0
        den = n[rows] + own.sizes[number] - num
        val = np.where(whole, 1.0, num / den)
        order = np.lexsort((number, -val, rows))
        order = order[(inside | ~whole)[order]]
        top = _ranks(rows[order])
        stay = whole[order] | (top <= limit)
        at = order[stay]
        return rows[at], number[at], np.where(whole[at], -1, num[at]), np.where(whole[at], -1, den[at]), val[at], top[stay]

    return _kept(index, _sets(files, file, value), file, lib, best, keep).select(file, lib, "val", "num", "den", "top")


def similar_files(files: DataFrame, libs: DataFrame, file: str, lib: str, value: str, k: int, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(lib, file, num, den, val, top): the k files most similar to each library, ties by file."""
    index = _index(libs, lib, value, index_rows)
    if index is None:
        # A group of files gives the k best of each library in the block that it meets.
        pairs = _blocks(_sets(files, file, value), libs, file, lib, value, lambda own, values, n: own.shared(values), index_rows, per_lib=k)
        return top_k(scored(pairs, "jaccard"), [lib], [F.desc("val"), file], k)

    def keep(own: Postings, rows, number, num, n):
        den = n[rows] + own.sizes[number] - num
        order = np.lexsort((rows, -(num / den), number))  # files come sorted
        at = order[_ranks(number[order]) <= k]
        return rows[at], number[at], num[at], den[at], num[at] / den[at], np.zeros(len(at))

    some = _kept(index, _sets(files, file, value).sortWithinPartitions(file), file, lib, lambda own, values, n: own.shared(values), keep).drop("top")
    return top_k(some, [lib], [F.desc("val"), file], k)


def _blocks(sets: DataFrame, libs: DataFrame, file: str, lib: str, value: str, look, index_rows: int, per_lib: int | None = None) -> DataFrame:
    """(file, lib, num, n_left, n_right) of what ``look`` finds in each block of libraries for each group of files.

    A library is in one block; a task holds one block's postings and one group's files. per_lib: only so many files of a
    group stay for each library, the most similar ones, ties by file.
    """
    rows = libs.select(lib, value).distinct()
    blocks, groups = max(1, -(-rows.count() // max(1 << 10, index_rows))), max(1, -(-sets.count() // GROUP_FILES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sets.withColumn("_g", F.pmod(F.xxhash64(file), F.lit(groups)).cast("int")).withColumn("_b", every(blocks))
    right = rows.withColumn("_b", F.pmod(F.xxhash64(lib), F.lit(blocks)).cast("int")).withColumn("_g", every(groups))
    kinds = {f.name: f.dataType.simpleString() for f in [*sets.schema.fields, *rows.schema.fields]}
    schema = f"`{file}` {kinds[file]}, `{lib}` {kinds[lib]}, num bigint, n_left bigint, n_right bigint"

    def meet(some: pa.Table, known: pa.Table) -> pa.Table:
        some = some.sort_by(file).combine_chunks()
        own, n = Postings(known.select([lib, value])), some.column("n").to_numpy()
        each = [look(own, v, k) for v, k in zip(some.column("values").to_pylist(), n.tolist(), strict=True)] if known.num_rows else [(np.zeros(0, np.int64),) * 2] * some.num_rows
        at = np.repeat(np.arange(some.num_rows), [len(x) for x, _ in each])
        number, num = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in each)]).astype(np.int64) for k in (0, 1))
        if per_lib is not None:
            order = np.lexsort((at, -(num / (n[at] + own.sizes[number] - num)), number))
            order = order[_ranks(number[order]) <= per_lib]
            at, number, num = at[order], number[order], num[order]
        return pa.table([some.column(file).take(pa.array(at)), own.libs.take(pa.array(number)), pa.array(num), pa.array(n[at].astype(np.int64)), pa.array(own.sizes[number].astype(np.int64))], [file, lib, "num", "n_left", "n_right"])

    return left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInArrow(meet, schema)


def _decided(pairs: DataFrame, file: str, lib: str, limit: int) -> DataFrame:
    """The candidates among pairs that hold all libraries within which a file is, and the limit's most similar ones."""
    inside, den = F.col("num") == F.col("n_left"), F.col("n_left") + F.col("n_right") - F.col("num")
    by = Window.partitionBy(file)
    # One pass: whether any library contains the file decides which of its pairs count, and how.
    marked = pairs.withColumn("_in", F.max(inside).over(by)).filter(inside | ~F.col("_in"))
    pick = lambda certain, near, name: F.when(F.col("_in"), F.lit(certain)).otherwise(near).alias(name)
    scored_ = marked.select(file, lib, "_in", pick(1.0, F.col("num") / den, "val"), pick(-1, F.col("num"), "num").cast("long"), pick(-1, den, "den").cast("long"))
    ranked = scored_.withColumn("top", F.row_number().over(by.orderBy(F.desc("val"), lib)))
    return ranked.filter(F.col("_in") | (F.col("top") <= limit)).drop("_in")


def contained(files: DataFrame, libs: DataFrame, file: str, lib: str, value: str) -> DataFrame:
    """(file, lib, num) of the libraries that hold all of a file's distinct literals; num is how many those are.

    A file is posted once, under the literal that the fewest libraries have, so it meets the libraries of one list instead
    of those of all its literals; a file with a literal that no library has (a null is such a literal) meets none. What it
    meets is verified against the libraries' literals by an equi-join. Files without rows are in no result.
    """
    wanted, held = files.select(file, digest(files, value).alias(value)).distinct(), libs.select(lib, digest(libs, value).alias(value)).distinct()
    seen = wanted.join(held.groupBy(value).agg(F.count("*").alias("_n")), value, "left")
    rare = seen.groupBy(file).agg(F.count("*").alias("num"), F.count("_n").alias("_known"), F.min_by(value, F.struct("_n", value)).alias(value)).filter("num = _known").select(file, "num", value)
    met = rare.join(held, value).select(file, lib, "num")
    found = met.join(wanted, file).join(held, [lib, value], "left_semi").groupBy(file, lib).agg(F.first("num").alias("num"), F.count("*").alias("_found"))
    return found.filter("_found = num").select(file, lib, "num")
