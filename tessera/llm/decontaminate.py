"""Benchmark decontamination by winnowing: minimum k-gram hash of each window, matched against the benchmark's, then extended."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table

WINDOW, KGRAM = 10, 5
#: Benchmark text that one pass over the documents holds in each worker; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20
#: Words that are hashed and winnowed at once.
CHUNK_WORDS = 1 << 18

_TO_SPACE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z and bytes from 0x80 on, after A-Z is lower-cased."""
    return (text or b"").translate(_TO_SPACE).split()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out = (out + h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(31))


def winnow(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """Minimum k-gram hash of each window of words; every window that two texts share has the same one in both."""
    m = _grams(h, k)
    for _ in range(window - k):
        m = np.minimum(m[1:], m[:-1])
    return m


class Index:
    """Windows of benchmark items by length, with their fingerprints. An item shorter than the window is one window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW, k: int = KGRAM):
        self.windows: dict[int, dict[bytes, list[int]]] = {}
        self.ids = [i for i, _ in items]
        self.k = k
        prints: dict[int, list[np.ndarray]] = {}
        for n, (_, text) in enumerate(items):
            if not (words := words_of(text)):
                continue
            length = min(window, len(words))
            known = self.windows.setdefault(length, {})
            for s in range(len(words) - length + 1):
                had = known.setdefault(b" ".join(words[s : s + length]), [])
                if not had or had[-1] != n:
                    had.append(n)
            prints.setdefault(length, []).append(winnow(self.hashes(words), length, min(k, length)))
        self.prints = {length: np.unique(np.concatenate(x)) for length, x in prints.items()}
        self.maps = {length: self._bitmap(x) for length, x in self.prints.items()}

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    @staticmethod
    def _bitmap(prints: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[prints >> np.uint64(44)] = True
        return out

    def match(self, words: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """(start, length, items) for each benchmark window that occurs in words."""
        h, found = self.hashes(words), []
        for length, known in self.windows.items():
            m = winnow(h, length, min(self.k, length))
            near = np.flatnonzero(self.maps[length][m >> np.uint64(44)])
            if len(near):
                at = np.searchsorted(self.prints[length], m[near])
                near = near[self.prints[length][np.minimum(at, len(self.prints[length]) - 1)] == m[near]]
            for s in near.tolist():  # extend: the whole window must agree, byte for byte
                if items := known.get(b" ".join(words[s : s + length])):
                    found.append((s, length, items))
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def search(index: Index, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, merged hit spans in words, ids of the items that occur) of each text, in chunks of many words."""
    out, words, ends = [], [], []

    def flush():
        cuts, spans, items = np.array(ends), [[] for _ in ends], [set() for _ in ends]
        for s, length, found in index.match(words) if words else ():
            d = int(np.searchsorted(cuts, s, side="right"))
            if s + length <= ends[d]:  # else it runs over the end of a text
                spans[d].append((s - (ends[d - 1] if d else 0),) * 2)
                spans[d][-1] = (spans[d][-1][0], spans[d][-1][0] + length)
                items[d].update(found)
        for d, end in enumerate(ends):
            out.append((end - (ends[d - 1] if d else 0), merged(spans[d]), sorted({index.ids[i] for i in items[d]})))
        words.clear(), ends.clear()

    for text in texts:
        words += words_of(text)
        ends.append(len(words))
        if len(words) >= CHUNK_WORDS:
            flush()
    flush()
    return out


_built: dict[str, Index] = {}


def _index(name: str, items, window: int, k: int) -> Index:
    """One index for each Python worker and block."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(items.value, window, k)
    return _built[name]


def _block_count(bench: DataFrame, id_col: str, text_col: str, most: int) -> int:
    total = bench.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")) + F.octet_length(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), F.lit(0))).first()[0]
    return max(1, -(-total // most))


def _blocks(bench: DataFrame, id_col: str, text_col: str, most: int) -> list[list[tuple[str, bytes | None]]]:
    """The benchmark's items in blocks of about ``most`` bytes; a benchmark within the bound is one block."""
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").cast("binary").alias("t")).filter("t is not null")
    n = _block_count(bench, id_col, text_col, most)
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, bytes(r.t)) for r in part.collect()]


SPANS = "array<struct<start:int,end:int>>"


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = KGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items) for each row of docs: hit word spans [start, end) and the item ids, sorted as strings.

    Map-side: the benchmark, in blocks of a checked size, goes to the workers; documents aren't shuffled unless there
    is more than one block, when only rows with hits meet again. Null and empty texts have no words; null and blank
    items none either; a null item id counts as the string "null"; items with equal ids are one; repeated documents
    give a row each; an empty benchmark hits nothing. Other columns aren't read. Memory is that of one batch of texts
    and one block's windows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, n_blocks = None, _block_count(bench, item_col, item_text, block_bytes)
    if n_blocks > 1:
        slim = materialise(slim, "decontaminate")  # so that row numbers are the same in each pass
    for n, items in enumerate(_blocks(bench, item_col, item_text, block_bytes)):
        sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, sent=sent, name=name, n=n):
            index = _index(name, sent, window, k)
            for b in batches:
                found = search(index, b.column(2).cast(pa.binary()).to_pylist())
                keep = range(len(found)) if n == 0 else [i for i, x in enumerate(found) if x[1]]
                take = pa.array(keep, pa.int64())
                spans = pa.array([[{"start": s, "end": e} for s, e in found[i][1]] for i in keep], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([found[i][0] for i in keep], pa.int64()), spans, pa.array([found[i][2] for i in keep], pa.list_(pa.string()))], ["rid", "doc_id", "n_words", "hits", "items"])

        part = slim.mapInArrow(run, f"rid bigint, doc_id {kind}, n_words bigint, hits {SPANS}, items array<string>")
        out = part if out is None else out.unionByName(part)
    if n_blocks == 1:
        return out.drop("rid")
    whole = out.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Sorted spans: a span opens a new one if it starts after all ends before it.
    fold = f"aggregate(hits, cast(array() as {SPANS}), (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).end, concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))), concat(acc, array(x))))"
    return whole.select("doc_id", "n_words", F.expr(fold).alias("hits"), "items")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = KGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs; one map-side pass for each block."""
    at = docs.columns.index(text_col)
    for n, items in enumerate(_blocks(bench, item_col, item_text, block_bytes)):
        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            index = _index(name, sent, window, k)
            for b in batches:
                found = search(index, b.column(at).cast(pa.binary()).to_pylist())
                yield b.filter(pa.array([not x[1] for x in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.coalesce(F.expr("aggregate(hits, 0L, (n, x) -> n + x.end - x.start)"), F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
