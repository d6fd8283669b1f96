"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text: its distinct words, and beginnings that at least two of its distinct words share, so that a stem
counts whose single forms are too rare to be learned one by one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table
from tessera.llm.decontaminate import words_of

#: Labelled documents that the model is fitted on: the bound of the sample.
SAMPLE_DOCS = 8000
#: Features at most (those of the largest excess; a bound on the model, not on documents), and by how many standard errors
#: their rate in toxic documents must exceed that in others. Features of clean documents are not used: they name topics.
MAX_FEATURES, MIN_Z = 4096, 4.0
#: Lengths of beginnings in bytes, and how many distinct longer words must share one.
STEM_LENGTHS, STEM_WORDS = (4, 5, 6), 2
#: Grades above 0 that toxic documents are dealt into.
TOXIC_GRADES = 3
#: A document is rejected from this probability of any toxicity (a grade above 0) on.
REJECT_AT = 0.5
STEPS, RATE, RIDGE = 400, 0.1, 1e-4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features_of(text: bytes | None) -> set[str]:
    """Words as they are, shared beginnings with a star; bytes stand as Latin-1 characters, so no text is cut wrongly."""
    words = set(words_of(text))
    out = {w.decode("latin-1") for w in words}
    for n in STEM_LENGTHS:
        shared = Counter(w[:n] for w in words if len(w) > n)
        out.update(p.decode("latin-1") + "*" for p, k in shared.items() if k >= STEM_WORDS)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray  # ascending; P(grade > k) = sigmoid(score - thresholds[k])
    basis: str = "features"  # where the grades come from that it learned: labels, features (see learn), or none

    def __post_init__(self):
        self.words = {f.encode("latin-1"): w for f, w in self.weights.items() if not f.endswith("*")}
        stems = {f[:-1].encode("latin-1"): w for f, w in self.weights.items() if f.endswith("*")}
        self.stems = {n: known for n in STEM_LENGTHS if (known := {p: w for p, w in stems.items() if len(p) == n})}

    def score(self, text: bytes | None) -> float:
        words = set(words_of(text))
        total = sum(self.words[w] for w in self.words.keys() & words)
        for n, known in self.stems.items():
            shared = Counter(filter(known.__contains__, [w[:n] for w in words if len(w) > n]))
            total += sum(known[p] for p, k in shared.items() if k >= STEM_WORDS)
        return total

    def above(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade > k) for each text and k. A feature counts once for each text."""
        scores = np.array([self.score(t) for t in texts], float)
        return _sigmoid(scores[:, None] - self.thresholds[None])


def fit(rows: list[tuple[int, list[int]]], n_features: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds that maximise the ridge-penalised cumulative-link likelihood (Adam steps).

    rows: (grade, indices of features present).
    """
    y = np.array([r[0] for r in rows], int)
    sizes = np.array([len(r[1]) for r in rows])
    flat = np.array([i for r in rows for i in r[1]], int)
    owner = np.repeat(np.arange(len(rows)), sizes)
    share = np.array([(y > k).mean() for k in range(grades)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(grades))
    theta = np.r_[np.zeros(n_features), start[0], np.log(np.maximum(np.diff(start), 1e-3))]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, cuts = theta[:n_features], np.cumsum(np.r_[theta[n_features], np.exp(theta[n_features + 1 :])])
        eta = np.bincount(owner, weights=w[flat], minlength=len(rows))
        above = np.c_[np.ones(len(y)), _sigmoid(eta[:, None] - cuts[None]), np.zeros(len(y))]  # P(grade >= k)
        slope = above * (1 - above)
        at = np.arange(len(y))
        p = np.maximum(above[at, y] - above[at, y + 1], 1e-12)
        g_eta = (slope[at, y] - slope[at, y + 1]) / p / len(y)
        g_cut = np.zeros(grades + 2)
        np.add.at(g_cut, y, -slope[at, y] / p / len(y))
        np.add.at(g_cut, y + 1, slope[at, y + 1] / p / len(y))
        g_cut = g_cut[1:-1]
        later = np.cumsum(g_cut[::-1])[::-1]
        grad = np.r_[np.bincount(flat, weights=g_eta[owner], minlength=n_features) - RIDGE * w, later[0], later[1:] * np.exp(theta[n_features + 1 :])]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], np.cumsum(np.r_[theta[n_features], np.exp(theta[n_features + 1 :])])


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from a bounded sample of labelled documents, whole texts each.

    labels has doc_id and toxic. A grade column of labels (integers from 0) is used as it is (basis ``labels``). Without
    one, the labels only tell toxic from other documents (grade 0): toxic ones are dealt into grades 1 to TOXIC_GRADES by
    how many of the features that mark toxic documents they have (basis ``features``), so grades above 0 then order
    documents by the density of such words, and only the threshold above 0 rests on labels. Null labels teach nothing;
    of several labels of a document the highest counts. Labels of one kind only, toxic or not, tell nothing apart: no
    document is rejected then (basis ``none``). A text that is null has no words.
    """
    graded = "grade" in labels.columns
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("grade" if graded else "toxic").cast("int")).alias("y")).filter("y is not null")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def featurise(batches):
        for b in batches:
            words = [sorted(features_of(t)) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], ["doc_id", "y", "words"])

    # The sample is bounded by its limit, so it may be broadcast; documents aren't shuffled.
    pairs = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = materialise(pairs.mapInArrow(featurise, f"doc_id {kind}, y int, words array<string>"), "toxic-sample")
    if sample.count() > sample_docs:  # repeated documents: one row of each
        sample = materialise(sample.dropDuplicates(["doc_id"]), "toxic-sample")
    n = sample.agg(F.count("*").alias("n"), F.expr("count_if(y > 0)").alias("bad")).first()
    good = n.n - n.bad
    if not n.bad or not good:
        return Model({}, np.full(TOXIC_GRADES, 20.0), "none")
    rates = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.expr("count_if(y > 0)").alias("k1"), F.expr("count_if(y = 0)").alias("k0"))
    p1, p0, p = F.col("k1") / n.bad, F.col("k0") / good, (F.col("k1") + F.col("k0")) / n.n
    z = (p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n.bad + 1 / good))
    least = min(MIN_Z, 0.5 * n.bad**0.5)
    marks = rates.filter("k0 + k1 >= 3").withColumn("z", z).filter(F.col("z") >= least).orderBy(F.desc("z"), "word").limit(MAX_FEATURES).collect()
    vocab = {r.word: i for i, r in enumerate(marks)}
    strong = {r.word for r in marks if r.k1 / n.bad > 10 * r.k0 / good}
    rows = sample.select("y", F.array_intersect("words", F.lit(list(vocab) or [""])).alias("words")).collect()
    found = [(r.y, [vocab[w] for w in r.words if w in vocab], sum(w in strong for w in r.words)) for r in rows]
    if graded:
        grades, rows = max(1, max(y for y, _, _ in found)), [(y, x) for y, x, _ in found]
    else:
        hits = np.array([h for y, _, h in found if y > 0])
        cuts = np.quantile(hits, [k / TOXIC_GRADES for k in range(1, TOXIC_GRADES)])
        grades, rows = TOXIC_GRADES, [(1 + int((h > cuts).sum()) if y > 0 else 0, x) for y, x, h in found]
    weights, thresholds = fit(rows, len(vocab), grades)
    return Model({w: float(weights[i]) for w, i in vocab.items()}, thresholds, "labels" if graded else "features")


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """(doc_id, p_toxic, severity, grade, grade_basis, rejected) of each row: severity is the expected grade, grade the likeliest one.

    Whole texts, map-side. A null, empty or blank text has no features and isn't rejected; repeated rows give a row
    each; other columns aren't read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            above = sent.value.above(texts)
            each = np.diff(np.c_[np.ones(len(texts)), above, np.zeros(len(texts))], axis=1)
            rejected = (above[:, 0] >= reject_at) & np.array([bool(t and t.strip()) for t in texts], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(each.argmin(1).astype(np.int32)), pa.array([sent.value.basis] * len(texts), pa.string()), pa.array(rejected)], ["doc_id", "p_toxic", "severity", "grade", "grade_basis", "rejected"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, p_toxic double, severity double, grade int, grade_basis string, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs, with all their columns, that aren't rejected; map-side."""
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            bad = sent.value.above(texts)[:, 0] >= reject_at
            yield b.filter(pa.array([not (x and t and t.strip()) for x, t in zip(bad.tolist(), texts, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, learn(docs, table(spark, sf_dir, "labels")))
