"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

P(token | history) = P(class | history) * P(cell | class, history) * P(token | cell). Both softmaxes have hashed features
of the real previous words: one back, both together, and two back alone (a skip) for the class; one back and two back, each
with the class, for the cell. The most frequent words have a cell of their own,
others share one by their shape. Within a cell, the only features are the words themselves, for which the
maximum-entropy solution is their share of it. Words seen less than twice in training are one cell, in which words never
seen are one event; in histories such a word stands for its shape.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, release, table

ADD = 0.1
#: Classes, and cells of a class.
CLASSES, WITHIN = 32, 32
CELLS = CLASSES * WITHIN
#: Cells: the end of a text, words seen less than twice, frequent words, and shapes of the other words.
END, RARE, HEADS = 0, 1, 510
SHAPES = CELLS - 2 - HEADS
#: Bits of a word's number in a history.
HISTORY_BITS = 20
#: A table has a bucket for so many training tokens, between 2 to the power of these.
TOKENS_A_BUCKET, LEAST_BITS, MOST_BITS = 8192, 10, 16
#: Rounds of gradients, each over one of so many equal shares of the training documents.
ROUNDS, SMOOTH, STEP = 4, 5.0, 0.35
#: Tokens of a block, and of a row of it, at most, unless a single text is longer. The JVM takes rows of over half a megabyte for huge objects.
BLOCK_TOKENS, ROW_TOKENS = 2 << 20, 1 << 17
#: Row groups and pages of the coded table: Spark's reader holds the bytes of a whole group in one array, and the writer looks at sizes every hundred rows else.
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}
SLICES, FAN_IN = 16, 64
#: Tokens read at once (unless a single text is longer), and tokens whose probabilities are worked out at once.
PIECE, CHUNK = 1 << 18, 1 << 13


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


#: Signs that may follow a word.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def shape_of(word: Column) -> Column:
    """Cell of a word that isn't frequent: its last two letters, and whether signs follow them."""
    stem = F.rtrim(word, F.lit(SIGNS))
    half = SHAPES // 2
    return (2 + HEADS + F.crc32(F.encode(F.right(stem, F.lit(2)), "UTF-8")) % half + F.when(stem == word, 0).otherwise(half)).cast("int")


def history_of(word: bytes) -> int:
    """A word's number in histories; those below CELLS stand for shapes."""
    return CELLS + zlib.crc32(word) % ((1 << HISTORY_BITS) - CELLS) if word != b" " else END


def _mixed(kind: int, a: np.ndarray, b: np.ndarray | int, bits: int) -> np.ndarray:
    """Bucket of a feature: its kind and two numbers of HISTORY_BITS at most."""
    x = (np.asarray(a, np.uint64) << np.uint64(HISTORY_BITS)) | np.asarray(b, np.uint64)
    x = (x * np.uint64(8) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Weights of the hashed features and biases of both softmaxes, as tables of buckets by classes or by cells of a class."""

    classes: np.ndarray
    cells: np.ndarray
    class_bias: np.ndarray
    cell_bias: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.classes).bit_length() - 1

    def scores(self, past: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the score of each class after each past (rows: one and two words back), and of each cell of the given cell's class.

        A weight is below 8 by its start and steps, so single precision holds the powers.
        """
        out = []
        for w, bias, found in ((self.classes, self.class_bias, class_features(past, self.bits)), (self.cells, self.cell_bias.take(cell // WITHIN, axis=0), cell_features(past, cell, self.bits))):
            z = w.take(found[0], axis=0)
            for f in found[1:]:
                z += w.take(f, axis=0)
            z += bias
            out.append(np.exp(z, out=z))
        return out[0], out[1]

    def probabilities(self, past: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P of each class after each past, and of each cell of the given cell's class."""
        return tuple(np.divide(z, (z @ np.ones(z.shape[1], np.float32))[:, None], out=z) for z in self.scores(past, cell))

    def log_token(self, past: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """log P(cell | past) of each token."""
        out = np.empty(len(cell))
        for i in range(0, len(cell), CHUNK):
            part = cell[i : i + CHUNK]
            a, b = self.scores(past[:, i : i + CHUNK], part)
            at, ones = np.arange(len(part)), np.ones(CLASSES, np.float32)
            p = a[at, part // WITHIN].astype(float) / (a @ ones) * b[at, part % WITHIN] / (b @ ones)
            out[i : i + CHUNK] = np.log(p)
        return out


def class_features(past: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_mixed(0, past[0], 0, bits), _mixed(1, past[0], past[1], bits), _mixed(2, past[1], 0, bits)]


def cell_features(past: np.ndarray, cell: np.ndarray, bits: int) -> list[np.ndarray]:
    own = cell // WITHIN
    return [_mixed(4, past[0], own, bits), _mixed(5, past[1], own, bits)]


def pasts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the words one and two before each token; before a text stand ends."""
    padded = np.r_[np.zeros(2, np.int64), words.astype(np.int64)]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(words)) - np.repeat(first, sizes)
    return np.stack([np.where(place >= d, padded[2 - d : len(padded) - d], END) for d in (1, 2)])


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that teach nothing: remainder 0, and those without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(10)) == 0, F.lit(True))


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2 to the power of 32, compressed, their bytes by significance."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(docs: DataFrame, kind: str) -> DataFrame:
    """Rows of two sorts: a run of a block's documents with their tokens (numbers of the block's own words), and a word of a block.

    A run holds about ROW_TOKENS tokens, and as large a part of the numbers in histories of the block's words as the other runs.
    """

    def run(batches):
        ids, held, sizes, stream = [], [], [], []
        local: defaultdict[bytes, int] = defaultdict()
        local.default_factory = local.__len__  # a new word gets the next number
        id_type, tokens_in = pa.int64(), 0
        columns = ["part", "run", "ids", "held", "sizes", "stream", "histories", "lid", "word", "n"]
        kinds = [pa.int64(), pa.int32(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
        part = 0

        def flush():
            nonlocal part
            n, words = np.zeros(len(local), np.int64), list(local)
            own = runs(np.array(sizes), ROW_TOKENS)
            histories = np.array_split(np.fromiter(map(history_of, words), np.uint32, len(words)), len(own))
            for k, (i, j) in enumerate(own):
                tokens = np.concatenate(stream[i:j])
                n += np.bincount(tokens[np.repeat(~np.array(held[i:j]), sizes[i:j])], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([part, k, ids[i:j], held[i:j], sizes[i:j], packed(tokens), packed(histories[k]), *[None] * 3], kinds, strict=True)], columns)
            none = [pa.nulls(len(words), k) for k in kinds[1:7]]  # these columns are a run's, not a word's
            rows = [pa.array(np.full(len(words), part)), *none, pa.array(np.arange(len(words)), pa.int32()), pa.array(words, pa.binary()), pa.array(n)]
            del words, tokens, histories
            for i in range(0, len(rows[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([v.slice(i, 1 << 16) for v in rows], columns)
            part += 1
            for x in (ids, held, sizes, stream):
                x.clear()
            local.clear()

        for b in batches:
            id_type = b.column(0).type
            kinds[2] = pa.list_(id_type)
            for doc, out, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                words = tokens_of(text.as_py())
                words.append(b" ")  # the end; no word holds a space
                ids.append(doc.as_py()), held.append(out), sizes.append(len(words))
                stream.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
                tokens_in += len(words)
                if tokens_in >= BLOCK_TOKENS:
                    yield from flush()
                    tokens_in = 0
        if ids:
            yield from flush()

    schema = f"part bigint, run int, ids array<{kind}>, held array<boolean>, sizes array<int>, stream binary, histories binary, lid int, word binary, n bigint"
    out = docs.mapInArrow(run, schema)
    return out.select((F.spark_partition_id().cast("long") * (1 << 24) + F.col("part")).alias("block"), *[c for c in out.columns if c != "part"])


def _bundled(batches):
    """Rows (block, lid, c, cell) as a few compressed rows for each block, so that many small rows needn't be shuffled."""
    names, rows, held = ["block", "lids", "low", "high", "cells"], 0, []

    def emit():
        block, lid, c, cell = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4))
        order = np.lexsort((lid, block))
        block, lid, c, cell = block[order], lid[order], c[order], cell[order]
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        spans = list(zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=True))
        blobs = [[packed(np.diff(x[i:j], prepend=0) if x is lid else x[i:j]) for i, j in spans] for x in (lid, c & 0xFFFFFFFF, c >> 32, cell)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(block[at]), *(pa.array(x, pa.binary()) for x in blobs)], names)

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= 1 << 20:
            yield emit()
            rows = 0
    if held:
        yield emit()


CODED = "held array<boolean>, sizes array<int>, tokens binary, known array<bigint>, base array<double>, within array<double>"


def _encode(stats: dict):
    """The runs of a block and the global counts of its words to coded tokens (history number and cell), base sums and within-cell sums."""
    norm = np.log10(stats["n"] + ADD * (stats["v"] + 1))
    unseen, mass = stats["unseen"], np.maximum(np.array(stats["mass"], float), 1)

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        block = block.sort_by("run")
        history = np.concatenate([unpacked(x) for x in block["histories"].to_pylist()]).astype(np.int64)
        c, cell = np.zeros(len(history), np.int64), np.zeros(len(history), np.int64)
        for blobs in zip(*(words[k].to_pylist() for k in ("lids", "low", "high", "cells")), strict=True):
            lid, low, high, own = (unpacked(x).astype(np.int64) for x in blobs)
            lid = np.cumsum(lid)
            c[lid], cell[lid] = low | high << 32, own
        rare = (c < 2) & (cell >= 2 + HEADS)
        within = np.where(cell >= 2 + HEADS, np.log10(np.maximum(c, 1) / mass[cell]), 0.0)
        within[rare & (c == 1)] = np.log10((1 - unseen) / stats["n1"]) if stats["n1"] else 0.0
        within[rare & (c == 0)] = np.log10(unseen)
        history[rare] = cell[rare]
        cell[rare] = RARE
        base, own, out = np.log10(c + ADD) - norm, (history << 10 | cell).astype(np.uint32), {k: [] for k in ("tokens", "known", "base", "within")}
        for stream, sizes in zip(block["stream"], block["sizes"], strict=True):
            tokens, sizes = unpacked(stream.as_py()), np.asarray(sizes.values, np.int64)
            starts = np.cumsum(sizes) - sizes
            out["tokens"].append(packed(own[tokens]))
            for k, v in (("known", (c > 0).astype(np.int64)), ("base", base), ("within", within)):
                out[k].append(np.add.reduceat(v[tokens], starts))
        kinds = {"tokens": pa.binary(), "known": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "within": pa.list_(pa.float64())}
        return pa.table({k: block[k] for k in ("ids", "held", "sizes")} | {k: pa.array(out[k], t) for k, t in kinds.items()})

    return run


def _pieces(sizes: np.ndarray, tokens: bytes, takes: np.ndarray | None = None):
    """(first document, its end, pasts, cells) of runs of documents of about PIECE tokens; takes: which documents."""
    raw = unpacked(tokens)
    ends = np.cumsum(sizes)
    for i, j in runs(sizes):
        own = raw[ends[i] - sizes[i] : ends[j - 1]]
        past, cell = pasts(own >> 10, sizes[i:j]), (own & (CELLS - 1)).astype(np.int64)
        if takes is not None:
            keep = np.flatnonzero(np.repeat(takes[i:j], sizes[i:j]))
            past, cell = past[:, keep], cell[keep]
        yield i, j, past, cell


def runs(sizes: np.ndarray, tokens: int = PIECE) -> list[tuple[int, int]]:
    """Runs of documents, each of so many tokens or a little more."""
    number = (np.cumsum(sizes) - sizes) // tokens
    at = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    return list(zip(at.tolist(), [*at[1:].tolist(), len(sizes)], strict=True))


def add_seen(out: tuple[np.ndarray, ...], past: np.ndarray, cell: np.ndarray, bits: int) -> None:
    """Adds each token to the counts of its features with its class or cell, and to those of the biases."""
    own, within = cell // WITHIN, cell % WITHIN
    for table_, found, target, width in ((out[0], class_features(past, bits), own, CLASSES), (out[1], cell_features(past, cell, bits), within, WITHIN)):
        for f in found:
            np.add.at(table_.reshape(-1), f * width + target, np.float32(1))
    out[2][:] += np.bincount(own, minlength=CLASSES)
    out[3][:] += np.bincount(cell, minlength=CELLS).reshape(CLASSES, WITHIN)


def add_expected(out: tuple[np.ndarray, ...], model: Model, past: np.ndarray, cell: np.ndarray, rng: np.random.Generator) -> None:
    """Adds to the first two tables what the model expects of the features: one draw of a class, and of a cell, for each token.

    A draw from the model's own distribution makes the gradient right on average, at a fraction of the cost of adding
    all probabilities; the generator's seed makes it the same on every run.
    """
    for i in range(0, len(cell), CHUNK):
        p, c = past[:, i : i + CHUNK], cell[i : i + CHUNK]
        for table_, z, found in zip(out[:2], model.scores(p, c), (class_features(p, model.bits), cell_features(p, c, model.bits)), strict=True):
            upto = np.cumsum(z, axis=1)
            drawn = (upto < rng.random(len(c), np.float32)[:, None] * upto[:, -1:]).sum(1)
            flat, width = table_.reshape(-1), table_.shape[1]
            for f in found:
                np.add.at(flat, f * width + np.minimum(drawn, width - 1), np.float32(1))


def _empty(bits: int) -> tuple[np.ndarray, ...]:
    return tuple(np.zeros(s, np.float32) for s in ((1 << bits, CLASSES), (1 << bits, WITHIN), (CLASSES,), (CLASSES, WITHIN)))


def _sums(coded: DataFrame, bits: int, model: Model | None, share: tuple[int, int]) -> list[tuple[np.ndarray, ...]]:
    """(seen, expected) of all features over the training documents of a share (number, of how many); expected needs a model.

    Each task sends one vector, cut into slices; slices are summed over FAN_IN tasks at a time, so no group grows with the tasks.
    """
    sent = coded.sparkSession.sparkContext.broadcast(model)
    now, of = share

    def run(batches):
        own, seen, expected = sent.value, _empty(bits), _empty(bits)
        for batch in batches:
            for held, sizes, tokens in zip(*(batch.column(i) for i in range(3)), strict=True):
                sizes = np.asarray(sizes.values, np.int64)
                takes = ~np.array(held.as_py(), bool) & (np.arange(len(sizes)) % of == now)
                rng = np.random.default_rng([now, len(sizes), int(sizes.sum())])
                for _, _, past, cell in _pieces(sizes, tokens.as_py(), takes):
                    add_seen(seen, past, cell, bits)
                    if own is not None:
                        add_expected(expected, own, past, cell, rng)
        flat = np.concatenate([x.ravel() for x in (*seen, *(expected[:2] if own is not None else ()))])
        for i, part in enumerate(np.array_split(flat, SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], ["slice", "data"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf.data.iloc[0]) // 4)
        for x in pdf.data:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"slice": [pdf.slice.iloc[0]], "part": [pdf.part.iloc[0]], "data": [total.astype(np.float32).tobytes()]})

    files = coded.rdd.getNumPartitions()
    tasks = max(1, min(files, 2 * coded.sparkSession.sparkContext.defaultParallelism), files // 4)
    parts = coded.select("held", "sizes", "tokens").coalesce(tasks).mapInArrow(run, "slice bigint, data binary").withColumn("part", F.spark_partition_id())
    while tasks > 1:
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("slice", "part").applyInPandas(merge, "slice bigint, part int, data binary")
        tasks = -(-tasks // FAN_IN)
    found = {r.slice: np.frombuffer(r.data, np.float32) for r in parts.collect()}
    flat = np.concatenate([found[i] for i in range(SLICES)]) if found else np.zeros(0, np.float32)
    out, at = [], 0
    for shapes in (_empty(bits), _empty(bits)[:2] if model is not None else ()):
        out.append(tuple(flat[(at := at + x.size) - x.size : at].reshape(x.shape).astype(np.float64) if found else x.astype(np.float64) for x in shapes))
    return out


def train(coded: DataFrame, bits: int, rounds: int = ROUNDS) -> Model:
    """Fits both softmaxes by gradients of the log-likelihood (counts seen less expected) that the executors sum.

    Weights start from smoothed ratios of counts over all training tokens. Each round takes one of ``rounds`` equal
    shares of the documents, so that all teach once; a feature's step is scaled by its counts.
    """
    (seen,) = _sums(coded, bits, None, (0, 1))[:1]
    p_class = (seen[2] + 0.5) / (seen[2] + 0.5).sum()
    p_cell = (seen[3] + 0.5) / (seen[3] + 0.5).sum(1, keepdims=True)
    overall = (seen[3].sum(0) + 0.5) / (seen[3].sum(0) + 0.5).sum()

    def start(counts, prior):
        return STEP * np.log((counts + SMOOTH * prior) / (counts.sum(1, keepdims=True) * prior + SMOOTH * prior))

    weights = [start(seen[0], p_class), start(seen[1], overall)]

    def model():
        return Model(*(w.astype(np.float32) for w in weights), np.log(p_class).astype(np.float32), np.log(p_cell).astype(np.float32))

    for r in range(rounds):
        there, expected = _sums(coded, bits, model(), (r, rounds))
        weights = [w + STEP * (s - e) / (np.maximum(s, e) + SMOOTH) for w, s, e in zip(weights, there[:2], expected, strict=True)]
    return model()


def bucket_bits(tokens: int) -> int:
    """The feature tables grow with the training tokens, up to what a worker should hold."""
    return min(MOST_BITS, max(LEAST_BITS, (tokens // TOKENS_A_BUCKET).bit_length()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> tuple[DataFrame, dict]:
    """Coded runs of all documents (a row each), and the statistics of the training words.

    Counts are exact and over all documents: a block sends its distinct words once, they are counted by word with a
    partial aggregation, and the counts come back by block through ``lookup``, so a word that every block has is no
    task's burden. No vocabulary is broadcast or collected; tables that are no longer needed are removed.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), (held_out(id_col) if held is None else held).alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = materialise(_blocks(slim, kind), "lm-blocks")
    words = blocks.filter("lid is not null").select("block", "lid", "word", "n")
    groups = materialise(words.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("rows")), "lm-words")
    heads = groups.filter((F.col("c") > 0) & (F.col("word") != F.lit(b" "))).orderBy(F.desc("c"), "word").limit(HEADS).select("word").collect()
    head = spark.createDataFrame([(bytes(r.word), 2 + i) for i, r in enumerate(heads)], "word binary, head int")
    end = F.col("word") == F.lit(b" ")
    cell = F.when(end, END).otherwise(F.coalesce(F.col("head"), shape_of(F.col("word").cast("string"))))
    celled = groups.join(F.broadcast(head), "word", "left").select("word", "c", "rows", cell.alias("cell"))  # HEADS rows
    stats = celled.groupBy("cell").agg(F.expr("count_if(c > 0)").alias("v"), F.expr("count_if(c = 1)").alias("n1"), F.expr("count_if(c = 2)").alias("n2"), F.sum("c").alias("n"), F.sum(F.when(F.col("c") >= 2, F.col("c"))).alias("mass"), F.sum("rows").alias("rows")).collect()
    mass, shaped = [0] * CELLS, [r for r in stats if r.cell >= 2 + HEADS]
    for r in stats:
        mass[r.cell] = r.mass or 0
    n1, n2 = sum(r.n1 for r in shaped), sum(r.n2 for r in shaped)
    known = {"n": sum(r.n for r in stats), "v": sum(r.v for r in stats), "n1": n1, "mass": mass, "unseen": (n1 + 1) / (n1 + 2 * n2 + 2) if n1 else 1.0}
    release()  # the shuffle of the counts has served
    back = lookup(words.select("block", "lid", "word"), celled, "word", "rows", "block", sum(r.rows for r in stats)).select("block", F.col("lid").cast("long"), "c", F.col("cell").cast("long"))
    back = back.mapInArrow(_bundled, "block bigint, lids binary, low binary, high binary, cells binary")
    left = blocks.filter("lid is null").select(F.col("block").alias("own"), "run", "ids", "held", "sizes", "stream", "histories")
    coded = materialise(left.groupBy("own").cogroup(back.groupBy("block")).applyInArrow(_encode(known), f"ids array<{kind}>, {CODED}"), "lm-coded", **SMALL_GROUPS)
    release(blocks, groups)
    return coded, known


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; scores are log10 probabilities.

    The model learns from every training token. Null or blank texts are one end token; a document without an id is held
    out; repeated rows count and come back like others; no training documents make every word unseen; an empty table
    gives no rows. Other columns aren't read. Memory: a block, the distinct words in it, and the feature tables.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    coded, known = encode(docs, id_col, text_col, held)
    model = train(coded, bucket_bits(known["n"]), rounds)
    sent, total = docs.sparkSession.sparkContext.broadcast(model), known["n"]

    def run(batches):
        m = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held_, sizes, tokens, known_, base, within = (batch.column(k)[i] for k in range(7))
                sizes = np.asarray(sizes.values, np.int64)
                sums = np.array(within.values)
                for first, end, past, cell in _pieces(sizes, tokens.as_py()):
                    own = sizes[first:end]
                    sums[first:end] += np.add.reduceat(m.log_token(past, cell), np.cumsum(own) - own) / np.log(10)
                yield pa.RecordBatch.from_arrays([ids.values, held_.values, pa.array(sizes), known_.values, pa.array(np.full(len(sizes), total, np.int64)), base.values, pa.array(sums)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
