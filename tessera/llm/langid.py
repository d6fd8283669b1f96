"""Language identification by prediction by partial matching: frozen per-language byte context trees score exact code lengths."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Distinct labelled texts a language is learned from, at most (whole texts, those of the smallest hashes).
DOCS_PER_LANGUAGE = 1500
#: Context length in bytes. Contexts of LONG bytes or more get a node if they occur so often.
ORDER, LONG, LEAST_COUNT = 4, 4, 2
#: Bytes scored at once.
CHUNK = 1 << 20
UNDETERMINED = "und"

_PAD = b" " * ORDER
_LETTER = re.compile(rb"[A-Za-z]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def _grams(s: np.ndarray) -> np.ndarray:
    """Each byte from number ORDER on, with the ORDER bytes before it, as one number."""
    out = np.zeros(max(len(s) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | s[k : k + len(out)].astype(np.uint64)
    return out


def _codes(texts: list[bytes]) -> np.ndarray:
    """The grams of all texts; each starts after spaces, which are no bytes of it."""
    own = np.repeat(np.tile([True, False], len(texts)), np.c_[[len(t) for t in texts], [ORDER] * len(texts)].ravel())
    return _grams(np.frombuffer(_PAD + _PAD.join(texts), np.uint8))[own[: -ORDER or None]]


def _tree(codes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A language's context tree from its grams: for each order (symbols after a context and their bits, contexts and the
    bits by which an unseen symbol is dearer than one byte of context less makes it). Escape method C with exclusion."""
    out, lower = [], None
    for k in range(ORDER + 1):
        grams, at = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(at, weights=counts)
        ctx, own, d = np.unique(grams >> np.uint64(8), return_inverse=True, return_counts=True)
        total = np.bincount(own, weights=n)
        below = np.full(len(grams), 1 / 256) if lower is None else lower[1][np.searchsorted(lower[0], grams & np.uint64((1 << 8 * k) - 1))]
        rest = np.maximum(1 - np.bincount(own, weights=below), 1e-12)
        whole = d == 256  # every byte was seen: nothing to escape to
        p = n / (total + np.where(whole, 0, d))[own]
        lower = (grams, p)
        escape = np.where(whole, 0.0, -np.log2(d / (total + d) / rest))
        node = np.full(len(ctx), True) if k < LONG else total >= LEAST_COUNT
        if not node.all():  # the bits of contexts without a node are those of one byte less
            lower = (grams, np.where(node[own], p, below))
        out.append((grams[node[own]], -np.log2(p[node[own]]), ctx[node], escape[node]))
    return out


class Lookup:
    """Numbers by key: open addressing in flat arrays, asked for many keys at once; 0 for unknown keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.mask = (1 << int(64 - self.shift)) - 1
        self.keys, self.values = np.full(self.mask + 1, _NONE), np.zeros(self.mask + 1, np.float32)
        at = self._start(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == _NONE]
            self.keys[at[free]] = keys[free]
            put = free[self.keys[at[free]] == keys[free]]  # of several for one place, one was put
            self.values[at[put]] = values[put]
            placed = np.zeros(len(keys), bool)
            placed[put] = True
            left = left[~placed[left]]
            at[left] = (at[left] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of the keys."""
        at = self._start(keys)
        there = self.keys.take(at)
        found = there == keys
        values = np.where(found, self.values.take(at), np.float32(0))
        left = np.flatnonzero(~found & (there != _NONE))
        while len(left):
            at = (at if len(at) == len(left) else at[left]) + 1 & self.mask
            own, there = keys.take(left), self.keys.take(at)
            hit = there == own
            values[left[hit]], found[left[hit]] = self.values.take(at[hit]), True
            on = ~hit & (there != _NONE)
            left, at = left[on], at[on]
        return values, found


@dataclass
class Model:
    trees: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]

    def __post_init__(self):
        self.langs = sorted(self.trees)
        self.tables = None

    def __getstate__(self):
        return {"trees": self.trees}  # the look-up tables are built where they are used

    def __setstate__(self, state):
        self.__init__(**state)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language."""
        if self.tables is None:
            self.tables = [[(Lookup(g, b), Lookup(c, e)) for g, b, c, e in self.trees[lang]] for lang in self.langs]
        out, start = np.zeros((len(texts), len(self.langs))), 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            out[start:end] = self._chunk(texts[start:end])
            start = end
        return out

    def _chunk(self, texts: list[bytes]) -> np.ndarray:
        """Each text apart from long ones, which go by pieces of CHUNK bytes with the bytes before them."""
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.langs)))
        if not sizes.sum():
            return out
        if len(texts) == 1 and sizes[0] > CHUNK:
            whole = _PAD + texts[0]
            for i in range(0, int(sizes[0]), CHUNK):
                out[0] += [x.sum() for x in self._bits(_grams(np.frombuffer(whole[i : i + CHUNK + ORDER], np.uint8)))]
            return out
        starts = np.cumsum(sizes) - sizes
        for k, bits in enumerate(self._bits(_codes(texts))):
            out[sizes > 0, k] = np.add.reduceat(bits.astype(np.float64), starts[sizes > 0])
        return out

    def _bits(self, codes: np.ndarray):
        """For each language, the code length of each gram's last byte after those before it."""
        for tables in self.tables:
            bits, left = np.zeros(len(codes), np.float32), np.arange(len(codes))
            for k in range(ORDER, -1, -1):
                key = codes.take(left) & np.uint64((1 << 8 * (k + 1)) - 1)
                cost, found = tables[k][0].get(key)
                bits[left] += cost
                left, key = left[~found], key[~found]
                if not len(left):
                    break
                bits[left] += tables[k][1].get(key >> np.uint64(8))[0]
            bits[left] += 8  # never seen at all: one of 256
            yield bits


def learn(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """A model from the columns lang and text of labelled rows; None if there are none. Null languages or texts teach nothing.

    Copies of a text teach once. Languages with more distinct texts than the bound are sampled by a hash of the text, whole
    texts each; grams are counted on the executors, each language's tree is built by a task from its counts, which the
    sample bounds, and the trees come to the driver. Every context of a language has a node, those of LONG bytes if they
    occur LEAST_COUNT times; all 256 bytes are symbols.
    """
    rows = labelled.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # Salted by the hash first, so that no task ranks all texts of a language.
    place = Window.partitionBy("lang", "salt").orderBy("hash")
    some = rows.select("lang", "hash").distinct().withColumn("salt", F.pmod("hash", F.lit(64))).withColumn("at", F.row_number().over(place)).filter(F.col("at") <= docs_per_language)
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("at") <= docs_per_language)
    if not (last := some.groupBy("lang").agg(F.max("hash").alias("hash")).collect()):
        return None
    bound = F.create_map(*[F.lit(x) for r in last for x in (r.lang, r.hash)])[F.col("lang")]
    chosen = rows.filter(F.col("hash") <= bound)
    sample = chosen.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        found: dict[str, list] = {}

        def emit():
            for lang, parts in found.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])
            found.clear()

        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            for lang in dict.fromkeys(langs):
                own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                for i in range(0, len(own), 256):
                    found.setdefault(lang, []).append(np.unique(_codes(own[i : i + 256]), return_counts=True))
            if sum(len(p[0]) for parts in found.values() for p in parts) > 1 << 22:
                yield from emit()
        yield from emit()

    def plant(group: pa.Table) -> pa.Table:
        tree = _tree(group["code"].to_numpy().astype(np.uint64), group["n"].to_numpy())
        data = [[x.astype(kind).tobytes() for x, kind in zip(order, ("<u8", "<f4", "<u8", "<f4"), strict=True)] for order in tree]
        return pa.table({"lang": [group["lang"][0].as_py()] * len(data), "k": pa.array(range(len(data)), pa.int32()), **{c: pa.array([d[i] for d in data], pa.binary()) for i, c in enumerate("gbce")}})

    sums = sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    trees: dict[str, list] = {}
    for r in sorted(sums.groupBy("lang").applyInArrow(plant, "lang string, k int, g binary, b binary, c binary, e binary").collect(), key=lambda r: (r.lang, r.k)):
        trees.setdefault(r.lang, []).append(tuple(np.frombuffer(x, kind) for x, kind in zip(r[2:], ("<u8", "<f4", "<u8", "<f4"), strict=True)))
    return Model(trees) if trees else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from the text alone; score is the share of the best language's likelihood.

    Null texts, texts without a letter and an empty model give ``und`` with score 0; ties go to the first language by
    name; repeated rows give a row each; other columns aren't read. Map-side; memory is that of one batch of texts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            known = [i for i, t in enumerate(texts) if m and t and has_letter(t)]
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if known:
                bits = m.code_lengths([texts[i] for i in known])
                best = bits.argmin(1)
                scores[known] = 1 / np.exp2(bits.min(1)[:, None] - bits).sum(1)
                for i, k in zip(known, best.tolist(), strict=True):
                    langs[i] = m.langs[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that teach nothing: remainder 1, and those without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(True))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
