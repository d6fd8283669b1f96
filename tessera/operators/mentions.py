"""Names of components in comments: how often each stands there, and which are used at all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.automaton import Automaton, as_pattern, joined, literal_part, standing

#: Bytes of names that one automaton holds; more names take more automata, each a pass over the comments.
BLOCK_BYTES = 1 << 17
#: Bytes of comments that are searched at once.
TEXT_BYTES = 2 << 20


def _blocks(names: DataFrame, name: str, most: int) -> list[list[str]]:
    """The distinct names that aren't null or empty, in blocks of about ``most`` bytes."""
    known = names.select(F.col(name).cast("string").alias("name")).filter("name != ''").distinct()
    total = known.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    for b in range(n):
        part = known if n == 1 else known.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == b)
        if found := sorted(r.name for r in part.collect()):
            yield found


def _pieces(b: pa.RecordBatch):
    """Runs of rows of about TEXT_BYTES."""
    sizes, at = np.cumsum([x.as_py() or 0 for x in pc.binary_length(b.column(1))]), 0
    while at < b.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + TEXT_BYTES, side="right")))
        yield b.slice(at, end - at)
        at = end


def _searched(comments: DataFrame, names: DataFrame, key: str, text: str, name: str, most: int, search, schema: str) -> DataFrame:
    """Union over the blocks of names of what search(block's broadcast value, texts) gives: (row, name, number) arrays."""
    kind = comments.schema[key].dataType.simpleString()
    slim = comments.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    out = comments.sparkSession.createDataFrame([], f"key {kind}, {schema}")
    for block in _blocks(names, name, most):
        sent = comments.sparkSession.sparkContext.broadcast(search.build(block))

        def run(batches, sent=sent):
            own, shown = sent.value, pa.array(sent.value.shown)
            for b in batches:
                for part in _pieces(b):
                    row, number, n = search(own, part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), shown.take(pa.array(number)), pa.array(n)], ["key", "name", "n"])

        out = out.unionByName(slim.mapInArrow(run, f"key {kind}, {schema}"))
    return out


class _Standing:
    @staticmethod
    def build(block: list[str]) -> Automaton:
        found = Automaton([n.encode() for n in block])
        found.shown = block
        return found

    def __call__(self, own: Automaton, texts):
        return standing(own, texts)


def name_counts(comments: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, name, n): how often each name stands in the comments of a key, between characters that aren't word ones.

    As if each name were searched by itself: case counts, any sign in a name is itself, an underscore separates, and the
    characters before and after belong to a place, so that neighbours can't share one. All names are found in one pass over
    each comment, by an automaton that goes to the tasks; its size is bounded by block_bytes, more names take more passes.
    Counts are summed before the shuffle. Null and empty names and comments count nothing.
    """
    found = _searched(comments, names, key, text, name, block_bytes, _Standing(), "name string, n bigint")
    return found.groupBy("key", "name").agg(F.sum("n").alias("n")).withColumnRenamed("key", key)


class _Used:
    """Names taken as patterns: one is tried where its longest plain part stands, or everywhere if it has none."""

    @staticmethod
    def build(block: list[str]):
        parts = [literal_part(n.encode()) for n in block]
        out = Automaton(sorted({p for p in parts if p}))
        out.shown, place = block, {p: k for k, p in enumerate(out.names)}
        out.of_part = [[] for _ in out.names]
        for k, p in enumerate(parts):
            if p:
                out.of_part[place[p]].append(k)
        out.everywhere = [k for k, p in enumerate(parts) if not p]
        out.patterns = [as_pattern(n.encode()) for n in block]
        return out

    def __call__(self, own, texts):
        data, gaps = joined(texts)
        part, last = own.find(data, gaps)
        # Places are reduced to pairs as arrays: as Python numbers they would take many times the texts' size.
        width = max(1, len(own.names))
        found = np.unique((np.searchsorted(gaps, last, side="right") - 1) * width + part)
        seen = zip((found // width).tolist(), (found % width).tolist(), strict=True)
        rows, numbers = [], []
        for row, text in enumerate(texts):
            for k in own.everywhere if text else ():
                if own.patterns[k] and own.patterns[k].search(text):
                    rows.append(row), numbers.append(k)
        for row, p in seen:
            for k in own.of_part[p]:
                if own.patterns[k] and own.patterns[k].search(texts[row]):
                    rows.append(row), numbers.append(k)
        return np.array(rows, np.int64), np.array(numbers, np.int64), np.ones(len(rows), np.int64)


def names_used(comments: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, name) of the names that a key's comments hold, each name taken as a pattern, as in ``a.b``, which finds a-b.

    Names that aren't patterns are found nowhere. One pass over each comment for all names, as in ``name_counts``; a
    name's pattern is tried only on comments that hold its longest plain part.
    """
    found = _searched(comments, names, key, text, name, block_bytes, _Used(), "name string, n bigint")
    return found.select("key", "name").distinct().withColumnRenamed("key", key)
