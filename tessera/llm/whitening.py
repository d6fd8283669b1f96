"""Embedding whitening: the covariance matrix in tiles of dimension pairs, then its unit eigenvectors."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

COMPONENTS = 32
#: Dimensions of a column block at least; there are MOST_BLOCKS column blocks at most, and as many copies of a block.
TILE, MOST_BLOCKS = 32, 8
#: Vectors of a row block.
ROWS = 8192
#: Entries become whole numbers: floor(SCALE * c) + OFFSET, held within 62 bits.
SCALE, OFFSET, LIMIT = 64.0, 1_000_000, float(1 << 62)
#: Eigenvalues below this share of the largest one are those of directions without variance.
FLAT = 1e-12


class Fit(NamedTuple):
    """What whitening learned from the n vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def _entries(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries (double) of the vectors, where each vector begins, and its length: 0 if it is null or has a null or non-finite entry."""
    lengths = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    begin = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    return x, begin, np.where(bad[begin + lengths] > bad[begin], 0, lengths)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """The entries as longs; those beyond 62 bits are held at the limit."""
    return np.clip(np.floor(SCALE * np.clip(x, -LIMIT, LIMIT)), -LIMIT, LIMIT / 2).astype(np.int64) + OFFSET


def _matrices(batches, at: int):
    """(record batch, places, matrix of whole numbers) by length of the vectors, of ROWS vectors at most."""
    for b in batches:
        x, begin, lengths = _entries(b.column(at))
        for d in np.unique(lengths[lengths > 0]):
            of = np.flatnonzero(lengths == d)
            for i in range(0, len(of), ROWS):
                part = of[i : i + ROWS]
                yield b, part, whole_numbers(x[begin[part][:, None] + np.arange(d)])


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (n, exact sum of each dimension)}: one row for each length and dimension reaches the driver."""

    def run(batches):
        total: dict[int, list] = {}
        for _, _, x in _matrices(batches, 0):
            n, high, low = total.get(x.shape[1], (0, 0, 0))
            total[x.shape[1]] = (n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0))
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, v, np.int64)) if isinstance(v, int) else pa.array(v) for v in (int(d), np.arange(d), n, high, low)], ["d", "k", "n", "high", "low"])

    cells = vectors.mapInArrow(run, "d bigint, k bigint, n bigint, high bigint, low bigint")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    out: dict[int, tuple[int, list[int]]] = {}
    for r in cells.groupBy("d", "k").agg(F.sum("n").alias("n"), *exact).orderBy("d", "k").collect():
        out.setdefault(r.d, (r.n, []))[1].append((int(r.high) << 32) + int(r.low))
    return out


class Centre:
    """Vectors less their mean: the nearest whole number below the mean goes first, exactly, then the fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.shift = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.fraction = self.rest / n

    def whole(self, x: np.ndarray) -> np.ndarray:
        return x - self.shift

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sum)^2, exactly; None where no long holds it."""
        y = self.whole(x)
        near = ((y - self.fraction) ** 2).sum(1) * float(self.n) ** 2
        fits = near < 2.0**63 * (1 - 1e-6)
        exact = ((np.where(fits[:, None], y, 0) * self.n - np.where(fits[:, None], self.rest, 0)) ** 2).sum(1)
        out: list[int | None] = exact.tolist()
        for k in np.flatnonzero(~fits):
            out[k] = None
            if near[k] < 2.0**63 * (1 + 1e-6) and (full := sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(y[k], self.rest, strict=True))) < 1 << 63:
                out[k] = full
        return out


def _packed(y: np.ndarray) -> bytes:
    """Column-major bytes of whole numbers in four bytes each where they fit, else in eight."""
    small = len(y) == 0 or max(abs(int(y.min())), abs(int(y.max()))) < 1 << 31
    return np.ascontiguousarray(y.T).astype("<i4" if small else "<i8").tobytes()


def _unpacked(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (width * rows)}").reshape(width, rows).astype(np.float64)


def covariance(vectors: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor n) of the vectors of length d.

    Each row block is cut into column blocks; a tile is a pair of them. A column block goes once to every tile that it is
    part of, keyed by row block and tile, so that tasks get equal shares whatever the data. A task multiplies the pairs
    of its share and adds them up by tile; the tiles' sums are then added by cell. d * d numbers reach the driver.
    """
    centre, width = Centre(n, sums), max(TILE, -(-d // MOST_BLOCKS))
    cuts = [(k, min(d, k + width)) for k in range(0, d, width)]

    def deal(batches):
        block = 0
        for b, _, x in _matrices(batches, 0):
            if x.shape[1] != d:
                continue
            here, y = b.column(1)[0].as_py(), centre.whole(x)
            packed = [_packed(y[:, s:e]) for s, e in cuts]
            tiles = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]
            sent = [(i, j, k) for i, j in tiles for k in {i, j}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([here] * len(sent), pa.int32()), pa.array([block] * len(sent), pa.int64()), *[pa.array([s[c] for s in sent], pa.int32()) for c in range(3)], pa.array([len(x)] * len(sent), pa.int32()), pa.array([packed[k] for _, _, k in sent], pa.binary())],
                ["part", "block", "i", "j", "side", "n", "data"],
            )
            block += 1

    def multiply(batches):
        tile, total, left = None, None, None

        def cells():
            i, j = tile
            at = np.arange(total.size)
            return pa.RecordBatch.from_arrays([pa.array(cuts[i][0] + at // total.shape[1]), pa.array(cuts[j][0] + at % total.shape[1]), pa.array(total.ravel())], ["p", "q", "v"])

        for b in batches:
            for r in b.to_pylist():
                if (r["i"], r["j"]) != tile:
                    if tile:
                        yield cells()
                    tile, total = (r["i"], r["j"]), np.zeros([e - s for s, e in (cuts[r["i"]], cuts[r["j"]])])
                s, e = cuts[r["side"]]
                z = _unpacked(r["data"], e - s, r["n"]) - centre.fraction[s:e, None]
                if r["side"] == r["i"] != r["j"]:
                    left = z  # its partner of the same row block comes next
                    continue
                total += (z if r["i"] == r["j"] else left) @ z.T
        if tile:
            yield cells()

    blocks = vectors.select(vectors.columns[0], F.spark_partition_id().alias("part")).mapInArrow(deal, "part int, block bigint, i int, j int, side int, n int, data binary")
    met = blocks.repartition("part", "block", "i", "j").sortWithinPartitions("i", "j", "part", "block", "side")
    sums_ = met.mapInArrow(multiply, "p bigint, q bigint, v double").groupBy("p", "q").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((d, d))
    out[sums_.p, sums_.q] = out[sums_.q, sums_.p] = sums_.v / n
    return out


def _scores(fit: Fit, centre: Centre, x: np.ndarray) -> np.ndarray:
    """Whitened coordinates; along directions without variance they are 0."""
    live = fit.values > 0
    return centre(x) @ np.where(live, fit.vectors / np.sqrt(np.where(live, fit.values, 1)), 0)


def _identity_error(vectors: DataFrame, d: int, fit: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    centre, k = Centre(fit.n, fit.sums), len(fit.values)

    def run(batches):
        total, first = np.zeros((k, k)), np.zeros(k)
        for _, _, x in _matrices(batches, 0):
            if x.shape[1] == d:
                w = _scores(fit, centre, x)
                total, first = total + w.T @ w, first + w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([total.ravel(), first]))], ["k", "v"])

    sums = vectors.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas().v.to_numpy() / fit.n
    live = fit.values > 0
    off = sums[: k * k].reshape(k, k) - np.outer(sums[k * k :], sums[k * k :]) - np.eye(k)
    return float(np.abs(off[np.ix_(live, live)]).max(initial=0.0))


def _numbers(vectors: DataFrame, vector_col: str) -> Column:
    """The vectors as they are if they are of floats, else as doubles."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    return F.col(vector_col) if single else F.col(vector_col).cast("array<double>")


def learn(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """{length: fit} of the vectors without null or non-finite entries; vectors of different length are fitted apart.

    Three passes over the vectors: exact sums, the tiled covariance of what is left after the mean is taken off, and a
    check of the result. All vectors count; a length's D * D matrix is decomposed on the driver.
    """
    slim = vectors.select(_numbers(vectors, vector_col).alias("v"))
    fits = {}
    for d, (n, sums) in _sums(slim).items():
        v = covariance(slim, d, n, sums)
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:components].copy(), axes[:, ::-1][:, :components].copy()
        values[values <= FLAT * max(values[0], 0)] = 0
        fit = Fit(n, sums, values, axes, float(np.trace(v)), 0.0)
        fits[d] = fit._replace(identity_error=_identity_error(slim, d, fit))
    return fits


def whiten(vectors: DataFrame, fits: dict[int, Fit], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error): arrays of components for each vector that was fitted.

    Vectors that are null or empty, or hold null or non-finite entries, give no row, nor do those of a length that has
    no fit. Repeated rows give a row each; equal vectors get equal coordinates. deviation is null beyond a long. Along
    directions without variance (a single vector, equal vectors, dimensions that depend on others) a coordinate is 0,
    and so is what the component explains. An empty table gives no rows. Other columns aren't read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    names = ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        centres = {d: Centre(f.n, f.sums) for d, f in fits.items()}
        for b, at, x in _matrices(batches, 1):
            if (fit := fits.get(x.shape[1])) is None:
                continue
            explained = (fit.values / fit.trace if fit.trace > 0 else np.zeros_like(fit.values)).tolist()
            w, m = _scores(fit, centres[x.shape[1]], x), len(x)
            data = [pa.array([fit.n] * m, pa.int64()), pa.array(centres[x.shape[1]].deviations(x), pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64())), pa.array([explained] * m, pa.list_(pa.float64())), pa.array([fit.identity_error] * m)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *data], names)

    return vectors.select(F.col(id_col).alias("vec_id"), _numbers(vectors, vector_col).alias("v")).mapInArrow(run, f"vec_id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = whiten(vectors, learn(vectors))
    cells = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "c"))
    return cells.select("vec_id", (F.col("component") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
