"""Topics: k-means over hashed term vectors of all documents, so that no list of words or patterns decides."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT_KEYS

#: Dimensions of the vectors, topics, and rounds of k-means.
DIM, TOPICS, ROUNDS = 64, 8, 6
#: Vectors are whole multiples of 1 / UNIT, so that sums don't depend on their order.
UNIT = 8192


def term_vector(text: bytes | None) -> tuple[int, np.ndarray]:
    """Words of a text, and its unit vector of damped hashed word counts (zero for a blank one)."""
    words = (text or b"").lower().split()
    out = np.zeros(DIM)
    if words:
        found = Counter(words)
        h = np.fromiter(map(zlib.crc32, found), np.int64, len(found))
        n = np.log1p(np.fromiter(found.values(), float, len(found)))
        out = np.bincount(h % DIM, weights=np.where(h // DIM % 2, n, -n), minlength=DIM)
        out /= np.sqrt(out @ out) or 1.0
    return len(words), np.rint(out * UNIT).astype(np.int16)


def terms(text: Column) -> Column:
    """Words and term vector of a text (binary, null: none), as a struct."""

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [term_vector(t) for t in texts]
        return pd.DataFrame({"words": pd.Series([n for n, _ in found], dtype="int64"), "vector": pd.Series([v.tobytes() for _, v in found], dtype=object)})

    return F.pandas_udf(run, "struct<words:bigint,vector:binary>")(text)


@dataclass
class Topics:
    """Centres, and the means that are taken off vectors first: what a topic is doesn't depend on the language."""

    means: dict[str, np.ndarray]
    rest: np.ndarray
    centres: np.ndarray

    def centred(self, groups: list[str], blobs: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(blobs), np.int16).reshape(-1, DIM).astype(float)
        return x - np.stack([self.means.get(g, self.rest) for g in groups]) if groups else x

    def of(self, groups: list[str], blobs: list[bytes]) -> np.ndarray:
        x = self.centred(groups, blobs)
        return ((self.centres**2).sum(1)[None] - 2 * x @ self.centres.T).argmin(1)


def _sums(vectors: DataFrame, of: list[str], kind: str, model: Topics | None = None) -> dict:
    """{key: (rows, sum of the vectors)}: by group, or by the nearest centre of the model. Each task sends a row for each of its keys."""
    sent = vectors.sparkSession.sparkContext.broadcast((set(of), model))

    def run(batches):
        known, m = sent.value
        n: Counter = Counter()
        total: dict = {}
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                groups, blobs = b.column(0).slice(i, 4096).to_pylist(), b.column(1).slice(i, 4096).to_pylist()
                keys = np.array([g if g in known else "" for g in groups], object) if m is None else m.of(groups, blobs)
                x = np.frombuffer(b"".join(blobs), np.int16).reshape(-1, DIM).astype(np.int64) if m is None else np.rint(m.centred(groups, blobs)).astype(np.int64)
                for k in set(keys.tolist()):
                    n[k] += int((keys == k).sum())
                    total[k] = total.get(k, 0) + x[keys == k].sum(0)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * DIM, pa.string() if m is None else pa.int64()), pa.array([n[k]] * DIM, pa.int64()), pa.array(range(DIM), pa.int64()), pa.array(v)], ["key", "n", "d", "v"])

    found = vectors.mapInArrow(run, f"key {kind}, n bigint, d bigint, v bigint").groupBy("key", "d").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in found:
        out.setdefault(r.key, (r.n, np.zeros(DIM)))[1][r.d] = r.v
    return out


def fit(vectors: DataFrame, k: int = TOPICS, rounds: int = ROUNDS) -> Topics:
    """Topics of a table of two columns, group (a string) and vector of ``terms``; every row takes part in every round.

    Groups with a thousandth of the rows or more (a thousand at most, by arithmetic) have a mean of their own, others
    share one. Centres start at k rows of the smallest hashes, and are the same on every run; an empty table has one
    topic.
    """
    vectors = vectors.toDF("group", "vector")
    total = vectors.count()
    large = [r[0] for r in vectors.groupBy("group").count().filter(F.col("count") >= max(1, -(-total // HOT_KEYS))).select("group").collect()]
    sums = _sums(vectors, large, "string")
    means = {g: v / n for g, (n, v) in sums.items() if g in large}
    n, v = (0, np.zeros(DIM)) if "" in large or "" not in sums else sums[""]
    model = Topics(means, v / max(n, 1), np.zeros((1, DIM)))
    seeds = vectors.distinct().orderBy(F.xxhash64("vector", "group"), "vector", "group").limit(k).collect()
    if not seeds:
        return model
    model.centres = model.centred([r[0] for r in seeds], [bytes(r[1]) for r in seeds])
    for _ in range(rounds):
        found = _sums(vectors, large, "bigint", model)
        model = Topics(means, model.rest, np.stack([found[i][1] / found[i][0] if i in found else c for i, c in enumerate(model.centres)]))
    return model


def topic_of(model: Topics, group: Column, vector: Column) -> Column:
    """The topic of a row as a column: t0, t1 and so on."""

    def run(groups: pd.Series, blobs: pd.Series) -> pd.Series:
        return pd.Series([f"t{t}" for t in model.of(groups.tolist(), blobs.tolist())], dtype=object)

    return F.pandas_udf(run, "string")(group, vector)
