"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, release, table, unit_hash
from tessera.llm.topics import fit, terms, topic_of

#: Up to so many cells (combinations that occur) are raked on the driver and broadcast; more are raked as a table.
MAX_CELLS = 1 << 16
#: Up to so many categories of all margins have their factors on the driver when cells are raked as a table.
MAX_CATEGORIES = 1 << 20
#: Where no target is given: shares are proportional to the present ones to this power, which lifts small categories.
TEMPER = 0.9
ROUNDS, TOLERANCE = 500, 1e-10
MARGINS = ("source", "lang", "topic")

Targets = dict[str, dict[str, float]]


def tempered(shares: dict[str, float], power: float = TEMPER) -> dict[str, float]:
    total = sum(v**power for v in shares.values() if v > 0) or 1.0
    return {k: v**power / total if v > 0 else 0.0 for k, v in shares.items()}


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]], rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """A weight for each cell so that weighted tokens have the target shares in each margin.

    Shares are taken over the categories that hold tokens; a category without a target gets none. Where some cells
    are empty and no exact answer exists, the last round's weights stand.
    """
    weights = {c: 1.0 for c, t in cells.items() if t > 0}
    total = sum(cells[c] for c in weights)
    for _ in range(rounds):
        worst = 0.0
        for m, target in enumerate(targets):
            now: dict[str, float] = defaultdict(float)
            for c, w in weights.items():
                now[c[m]] += w * cells[c]
            there = sum(target.get(k, 0.0) for k, v in now.items() if v > 0)
            if there <= 0:
                continue
            factor = {k: total * target.get(k, 0.0) / there / v if v > 0 else 0.0 for k, v in now.items()}
            worst = max([worst, *(abs(f - 1) for k, f in factor.items() if now[k] > 0)])
            for c in weights:
                weights[c] *= factor[c[m]]
        if worst < TOLERANCE:
            break
    return weights


def _packed(cells: DataFrame, names: list[str], numbers: list[DataFrame]) -> DataFrame:
    """The cells as a few rows of packed arrays: a category number for each margin, and tokens."""
    coded = cells
    for m, (name, known) in enumerate(zip(names, numbers, strict=True)):
        coded = coded.join(F.broadcast(known.select(name, F.col("number").alias(f"c{m}"))), name)  # MAX_CATEGORIES rows at most
    columns = [f"c{m}" for m in range(len(names))]

    def run(batches):
        for b in batches:
            parts = [b.column(m).to_numpy().astype("<i4").tobytes() for m in range(len(names))] + [b.column(len(names)).to_numpy().astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], [*columns, "tokens"])

    return materialise(coded.select(*columns, "tokens").mapInArrow(run, ", ".join(f"{c} binary" for c in [*columns, "tokens"])), "packed-cells")


def _weighted(packed: DataFrame, factors: list[np.ndarray], margin: int) -> np.ndarray:
    """Weighted tokens of each category of a margin; a cell's weight is the product of its categories' factors."""
    sent = packed.sparkSession.sparkContext.broadcast(factors)

    def run(batches):
        own = sent.value
        total = np.zeros(len(own[margin]))
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                at = [np.frombuffer(x, "<i4") for x in row[:-1]]
                w = np.frombuffer(row[-1], "<f8")
                for f, k in zip(own, at, strict=True):
                    w = w * f[k]
                total += np.bincount(at[margin], weights=w, minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "v"])

    found = packed.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(len(factors[margin]))
    out[found.k] = found.v
    sent.unpersist()
    return out


def _rake_packed(cells: DataFrame, names: list[str], numbers: list[DataFrame], shares: list[np.ndarray], rounds: int = ROUNDS) -> DataFrame:
    """The same where a factor for each category fits: cells are packed once, a round is one pass over them for each margin."""
    packed, factors = _packed(cells, names, numbers), [np.ones(len(s)) for s in shares]
    total = cells.agg(F.sum("tokens")).first()[0]
    for _ in range(rounds if total else 0):
        worst = 0.0
        for m, share in enumerate(shares):
            now = _weighted(packed, factors, m)
            there = share[now > 0].sum()
            if there <= 0:
                continue
            factor = np.divide(total * share / there, now, out=np.zeros(len(now)), where=now > 0)
            worst = max(worst, np.abs(factor[now > 0] - 1).max(initial=0.0))
            factors[m] = factors[m] * factor
        if worst < TOLERANCE:
            break
    release(packed)
    out = cells.withColumn("w", F.lit(1.0))
    for m, (name, known) in enumerate(zip(names, numbers, strict=True)):
        f = cells.sparkSession.createDataFrame(pd.DataFrame({"number": np.arange(len(factors[m])), "f": factors[m]}), "number int, f double")
        out = out.join(F.broadcast(known.select(name, "number").join(f, "number").select(name, "f")), name).withColumn("w", F.col("w") * F.col("f")).drop("f")
    return materialise(out, "cells")


def _rake_table(cells: DataFrame, names: list[str], targets: list[DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The same for more cells than the driver should hold. Cells hold tokens; targets are (category, share).

    With up to MAX_CATEGORIES categories in all, each has its factor on the driver, and cells are only read. With more,
    each margin is a grouped sum joined back.
    """
    numbered, shares = [], []
    for name, target in zip(names, targets, strict=True):
        known = cells.select(name).distinct().join(target, name, "left").select(name, F.coalesce("share", F.lit(0.0)).alias("share"))
        numbered.append(materialise(known, "categories"))
    if sum(known.count() for known in numbered) <= MAX_CATEGORIES:
        for m, known in enumerate(numbered):
            found = known.toPandas()
            found["number"] = np.arange(len(found), dtype=np.int32)
            shares.append(found["share"].to_numpy(np.float64))
            numbered[m] = cells.sparkSession.createDataFrame(found, f"{names[m]} string, share double, number int")
        return _rake_packed(cells, names, numbered, shares, rounds)
    return _rake_joined(cells, names, targets, rounds)


def _rake_joined(cells: DataFrame, names: list[str], targets: list[DataFrame], rounds: int = ROUNDS) -> DataFrame:
    cells = cells.withColumn("w", F.lit(1.0))
    total = cells.agg(F.sum("tokens")).first()[0]
    for _ in range(rounds if total else 0):
        worst = 0.0
        for name, target in zip(names, targets, strict=True):
            now = cells.groupBy(name).agg(F.sum(F.col("w") * F.col("tokens")).alias("now")).filter("now > 0").join(target, name, "left")
            now = now.withColumn("share", F.coalesce("share", F.lit(0.0)))
            there, low, high = now.agg(F.sum("share"), F.min(F.col("share") / F.col("now")), F.max(F.col("share") / F.col("now"))).first()
            if not there:
                continue
            scale = total / there
            worst = max(worst, abs(scale * low - 1), abs(scale * high - 1))
            factor = now.select(name, (scale * F.col("share") / F.col("now")).alias("f"))
            cells = cells.join(factor, name, "left").withColumn("w", F.col("w") * F.coalesce("f", F.lit(0.0))).drop("f")
        before, cells = cells, materialise(cells, "cells")
        release(before)  # one table of cells at a time
        if worst < TOLERANCE:
            break
    return cells


def calibrated(docs: DataFrame, margins: dict[str, Column], tokens: Column, targets: Targets | None = None, power: float = TEMPER, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs with ``n_tokens`` and ``p_keep``: the probability at which a document is sampled.

    The cells' weights are raked to all margins and scaled so that the largest is 1, hence sampled tokens have the
    target shares in expectation, and no document is needed twice. A margin without a target is tempered. Null
    categories count as the empty string, null tokens as none. Cells without tokens have probability 0 unless all have
    none. Up to max_cells cells are raked on the driver, more as a table: the arithmetic and the rule to stop are the
    same. Columns of docs keep their names whatever they are, but for n_tokens and p_keep, which are replaced. docs must
    give the same rows when it is read again.
    """
    names = [n for n in docs.columns if n not in ("n_tokens", "p_keep")]
    keys = [f"m{i}" for i in range(len(margins))]
    rows = docs.select(F.struct(*names).alias("doc"), F.coalesce(tokens.cast("long"), F.lit(0)).cast("long").alias("tokens"), *(F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in zip(keys, margins.values(), strict=True)))
    cells = materialise(rows.groupBy(*keys).agg(F.sum("tokens").cast("double").alias("tokens"), F.count("*").alias("n")), "cells")
    spark = docs.sparkSession
    counted = cells.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if counted[0] <= max_cells:
        table_ = {tuple(r[k] for k in keys): r.tokens for r in cells.collect()}
        aims = []
        for i, name in enumerate(margins):
            now: dict[str, float] = defaultdict(float)
            for c, t in table_.items():
                now[c[i]] += t
            aims.append((targets or {}).get(name) or tempered(now, power))
        weights = rake(table_, aims)
        top = max(weights.values(), default=0.0)
        found = [(*c, weights.get(c, 0.0) / top if top else 1.0) for c in table_]
        small = spark.createDataFrame(found, ", ".join([*(f"{k} string" for k in keys), "p double"]))
        out = rows.join(F.broadcast(small), keys)  # max_cells rows at most
    else:
        aims = []
        for name, k in zip(margins, keys, strict=True):
            if own := (targets or {}).get(name):
                aims.append(spark.createDataFrame(list(own.items()), f"{k} string, share double"))
            else:
                sums = cells.groupBy(k).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("share", F.pow("t", F.lit(power)))
                aims.append(materialise(sums.select(k, (F.col("share") / (sums.agg(F.sum("share")).first()[0] or 1.0)).alias("share")), "aims"))
        raked = _rake_table(cells.filter("tokens > 0"), keys, aims)
        top = raked.agg(F.max("w")).first()[0]
        p = F.coalesce(F.col("w") / top, F.lit(0.0)) if top else F.lit(1.0)
        groups = cells.select(*keys, "n").join(raked.select(*keys, "w"), keys, "left").select(F.struct(*keys).alias("cell"), "n", p.alias("p"))
        keyed = rows.select("doc", "tokens", F.struct(*keys).alias("cell"), F.monotonically_increasing_id().alias("at"))
        out = lookup(keyed, groups, "cell", "n", "at", counted[1])
    return out.select("doc.*", F.col("tokens").alias("n_tokens"), F.col("p").alias("p_keep"))


def _placed(docs: DataFrame, keep: list[Column], id_col: str, text_col: str) -> DataFrame:
    """``keep`` of each row with _source, _lang, _topic, _words and _u, a number in [0, 1) that its id and text fix.

    Texts are read once, for words and term vectors, which are written. A topic column of docs is used as it is; without
    one, topics come from the k-means model of ``topics``, fitted on all rows.
    """
    own = [F.col("topic").cast("string").alias("_topic")] if "topic" in docs.columns else []
    rows = docs.select(*keep, F.col("source").alias("_source"), F.col("lang").alias("_lang"), *own, unit_hash(id_col, text_col).alias("_u"), terms(F.col(text_col).cast("string").cast("binary")).alias("_terms"))
    rows = rows.select("*", F.col("_terms.words").alias("_words"), *([] if own else [F.col("_terms.vector").alias("_vector")])).drop("_terms")
    rows = materialise(rows, "placed")
    if own:
        return rows
    group = F.coalesce(F.col("_lang").cast("string"), F.lit(""))
    return rows.withColumn("_topic", topic_of(fit(rows.select(group, "_vector")), group, F.col("_vector"))).drop("_vector")


def _drawn(docs: DataFrame, keep: list[Column], targets: Targets | None, power: float, id_col: str, text_col: str) -> DataFrame:
    rows = _placed(docs, keep, id_col, text_col)
    margins = {"source": F.col("_source"), "lang": F.col("_lang"), "topic": F.col("_topic")}
    return calibrated(rows, margins, F.col("_words"), targets, power)


def probabilities(docs: DataFrame, targets: Targets | None = None, power: float = TEMPER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, p_keep, kept) of each row of docs."""
    out = _drawn(docs, [F.col(id_col).alias("_id")], targets, power, id_col, text_col)
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), "n_tokens", "p_keep", (F.col("_u") < F.col("p_keep")).alias("kept"))


def sample(docs: DataFrame, targets: Targets | None = None, power: float = TEMPER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents drawn, with all their columns: a hash of id and text below the document's probability.

    The same rows are drawn on every run; equal rows are drawn together. An empty docs gives no rows. The documents are
    written once with their vectors; with up to MAX_CELLS cells no text is shuffled.
    """
    out = _drawn(docs, [F.struct(*docs.columns).alias("_doc")], targets, power, id_col, text_col)
    return out.filter(F.col("_u") < F.col("p_keep")).select("_doc.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(table(spark, sf_dir, "documents"))
