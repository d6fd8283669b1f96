"""Embedding near-duplicates: PCA-ordered tiles, leading dimensions first, residuals bounded by suffix norms."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, table
from tessera.llm.components import components
from tessera.llm.sharding import shard_by_bytes

THRESHOLD = 0.9
#: Vectors of a block (two blocks meet in a task) and of a tile.
BLOCK, TILE = 4096, 1024
#: Leading axes along which blocks are bounded by boxes, and those whose cells are the keys by which blocks meet.
AXES, CELL_AXES = 8, 2
#: Shares of the dimensions after which the bound is tried.
STAGES = (0.25, 0.5, 1.0)
#: Room for rounding of the single-precision partial products; pairs within it are decided in double precision.
SLACK = 1e-4
PAIR_CHUNK = 1 << 16


def _stack(col: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None for null, empty, zero or non-finite ones."""
    out = []
    for v in col:
        x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, np.float64)
        out.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def _encode(kind: str):
    """Valid vectors as the bytes of their numbers (a negative zero as zero), others as null."""

    def run(batches):
        for b in batches:
            data = pa.array([None if x is None else (x + 0.0).astype(kind).tobytes() for x in _stack(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data], ["vec_id", "vec"])

    return run


def _matrix(blobs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(distinct: DataFrame, dim: int, kind: str) -> np.ndarray:
    """Orthonormal axes of all unit vectors, from the largest second moment to the smallest; dim * dim sums reach the driver."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                u = _unit(_matrix(b.column(0)[i : i + BLOCK].to_pylist(), kind))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["k", "v"])

    sums = distinct.select("vec").mapInArrow(moments, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros(dim * dim)
    m[sums.k] = sums.v
    return np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1].copy()


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of i[k] with j[k] for all k; parents are smaller indices."""
    while len(i):
        i, j = parent[i], parent[j]
        while (parent[i] != i).any() or (parent[j] != j).any():
            i, j = parent[i], parent[j]
        open_ = i != j
        i, j = np.maximum(i, j)[open_], np.minimum(i, j)[open_]
        np.minimum.at(parent, i, j)


class Tiles:
    """Links among unit vectors a (and b), found tile by tile."""

    def __init__(self, axes: np.ndarray, threshold: float):
        self.axes, self.threshold = axes, threshold
        self.cuts = sorted({max(1, int(len(axes) * s)) for s in STAGES})

    def prepare(self, x: np.ndarray):
        unit = _unit(x)
        turned = unit @ self.axes
        square = turned**2
        rest = [np.sqrt(np.maximum(square[:, c:].sum(1), 0)).astype(np.float32) for c in self.cuts]
        return unit, turned.astype(np.float32), rest

    def _dense(self, a, b, sa, sb, ta, tb):
        """Pairs of a tile that can reach the threshold by the bound of some stage, stopping when none is left."""
        part, done = np.zeros((len(a), len(b)), np.float32), 0
        for k, cut in enumerate(self.cuts):
            part += a[:, done:cut] @ b[:, done:cut].T
            done = cut
            keep = part + sa[k][ta][:, None] * sb[k][tb][None] >= self.threshold - SLACK
            n = np.count_nonzero(keep)
            if n == 0 or n <= keep.size // 64 or cut == len(self.axes):
                i, j = np.nonzero(keep)
                return i, j, part[i, j], k
        raise AssertionError

    def links(self, left, right, same: bool):
        """Yields (i, j) index arrays of linked pairs, i < j within one block; every pair is decided in double precision."""
        (ua, ra, sa), (ub, rb, sb) = left, right
        for s in range(0, len(ra), TILE):
            for t in range(s if same else 0, len(rb), TILE):
                ta, tb = slice(s, s + TILE), slice(t, t + TILE)
                i, j, part, k = self._dense(ra[ta], rb[tb], sa, sb, ta, tb)
                i, j = i + s, j + t
                if same and s == t:
                    i, j, part = i[i < j], j[i < j], part[i < j]
                for k2 in range(k + 1, len(self.cuts)):
                    cut = slice(self.cuts[k2 - 1], self.cuts[k2])
                    part = part + np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", ra[i[p : p + PAIR_CHUNK], cut], rb[j[p : p + PAIR_CHUNK], cut]) for p in range(0, len(i), PAIR_CHUNK))])
                    ok = part + sa[k2][i] * sb[k2][j] >= self.threshold - SLACK
                    i, j, part = i[ok], j[ok], part[ok]
                for p in range(0, len(i), PAIR_CHUNK):
                    x, y = i[p : p + PAIR_CHUNK], j[p : p + PAIR_CHUNK]
                    ok = np.einsum("ij,ij->i", ua[x], ub[y]) >= self.threshold
                    if ok.any():
                        yield x[ok], y[ok]


def compare_blocks(tiles: Tiles, first: pd.DataFrame, second: pd.DataFrame | None, kind: str = "<f8") -> pd.DataFrame:
    """(node, root, links): for each vector with a link its count of linked rows, and a spanning link to its root."""
    left = tiles.prepare(_matrix(first.vec, kind))
    right = left if second is None else tiles.prepare(_matrix(second.vec, kind))
    shift = 0 if second is None else len(first)
    both = first if second is None else pd.concat([first, second], ignore_index=True)
    n, counts, parent = both.n.to_numpy(), np.zeros(len(both)), np.arange(len(both))
    for i, j in tiles.links(left, right, second is None):
        j = j + shift
        counts += np.bincount(i, weights=n[j], minlength=len(n)) + np.bincount(j, weights=n[i], minlength=len(n))
        _join(parent, i, j)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    at = np.flatnonzero(counts)
    return pd.DataFrame({"node": both.node.to_numpy()[at], "root": both.node.to_numpy()[parent[at]], "links": counts[at].astype(np.int64)})


def _block_pairs(spans: DataFrame, threshold: float, width: int = 1) -> DataFrame:
    """(first, second) blocks that may hold links, each pair once, first <= second.

    Unit vectors with this cosine differ by at most ``reach`` along any axis: blocks meet by an equi-join on cells of the
    first CELL_AXES axes together, and only where their boxes are near along all leading axes and the largest product that the boxes and the
    norms beyond them allow reaches the threshold.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    cells = lambda k, out: F.sequence(*(F.floor((F.col(c)[k] + shift) / reach).cast("int") for c, shift in (("lo", -out), ("hi", out))))
    keys = [f"cell{k}" for k in range(min(CELL_AXES, width))]
    own, other = spans, spans
    for k, key in enumerate(keys):
        own, other = own.withColumn(key, F.explode(cells(k, 0))), other.withColumn(key, F.explode(cells(k, reach)))
    other = other.select(*keys, F.col("block").alias("second"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("rest").alias("rest2"))
    met = own.join(other, keys).filter(F.col("block") <= F.col("second"))
    near = F.forall(F.arrays_zip("lo", "hi", "lo2", "hi2"), lambda x: (x["lo2"] - x["hi"] <= reach) & (x["lo"] - x["hi2"] <= reach))
    most = F.aggregate(F.arrays_zip("lo", "hi", "lo2", "hi2"), F.col("rest") * F.col("rest2"), lambda s, x: s + F.greatest(x["lo"] * x["lo2"], x["lo"] * x["hi2"], x["hi"] * x["lo2"], x["hi"] * x["hi2"]))
    return met.filter(near & (most >= threshold - SLACK)).select(F.col("block").alias("first"), "second").distinct()


def _dimension_links(distinct: DataFrame, dim: int, threshold: float, kind: str) -> DataFrame:
    """(node, root, links) of all vectors of one dimension, by pairs of blocks."""
    axes = principal_axes(distinct, dim, kind)
    lead = axes[:, :AXES]

    def project(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                y = _unit(_matrix(part.column(2).to_pylist(), kind)) @ lead
                rest = np.sqrt(np.maximum(1 - (y * y).sum(1), 0)) + SLACK
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y.tolist(), pa.list_(pa.float64())), pa.array(rest)], ["node", "n", "vec", "y", "rest"])

    total = distinct.count()
    blocks = max(1, -(-total // BLOCK))
    placed = distinct.select("node", "n", "vec").mapInArrow(project, "node bigint, n bigint, vec binary, y array<double>, rest double")
    # Contiguous runs of equal length in the order of slabs across the first axis, then the second axis, whatever the partitions.
    slab = F.floor(F.col("y")[0] * 4).cast("int")
    placed = placed.withColumns({"slab": slab, "next": F.element_at("y", min(2, dim))})
    placed = materialise(shard_by_bytes(placed, F.lit(1).cast("long"), ["slab", "next", "node"], blocks).withColumnRenamed("shard", "block").drop("size", "slot", "slab", "next"), "vector-blocks")
    width = min(AXES, dim)
    spans = placed.groupBy("block").agg(F.array(*[F.min(F.col("y")[k]) for k in range(width)]).alias("lo"), F.array(*[F.max(F.col("y")[k]) for k in range(width)]).alias("hi"), F.max("rest").alias("rest"))
    pairs = materialise(_block_pairs(spans, threshold, width), "block-pairs")
    uses = pairs.select(F.col("first").alias("block"), "first", "second").unionByName(pairs.filter("first < second").select(F.col("second").alias("block"), "first", "second"))
    tiles = Tiles(axes, threshold)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group.block == group["first"]], group[group.block != group["first"]]
        return compare_blocks(tiles, a.reset_index(drop=True), b.reset_index(drop=True) if len(b) else None, kind)

    dealt = placed.select("block", "node", "n", "vec").join(uses, "block")
    return dealt.groupBy("first", "second").applyInPandas(meet, "node bigint, root bigint, links bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Two vectors link if the cosine of their doubles is at least the threshold; all pairs are covered, and what the
    bounds can't rule out is decided in double precision. Equal vectors are one node with a count. A task compares two
    blocks and gives counts and spanning links, so a group of copies or near copies never becomes all its pairs.
    Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing; vectors of
    different length don't link with each other. component_id is the smallest id reachable (null if all are null);
    repeated rows count like others. An empty table gives no rows. Other columns aren't read.
    """
    id_kind = vectors.schema[id_col].dataType.simpleString()
    # Single-precision numbers travel as such; all arithmetic on them is in double precision.
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialise(slim.mapInArrow(_encode(kind), f"vec_id {id_kind}, vec binary"), "vectors")
    groups = rows.filter("vec is not null").groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    groups = materialise(groups.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    dims = [r[0] for r in groups.select((F.length("vec") / int(kind[2])).cast("int").alias("d")).distinct().collect()]
    links = rows.sparkSession.createDataFrame([], "node bigint, root bigint, links bigint")
    for dim in dims:
        links = links.unionByName(_dimension_links(groups.filter(F.length("vec") == int(kind[2]) * dim), dim, threshold, kind))
    links = materialise(links, "vector-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links, "node", "root")
    labelled = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = labelled.join(least, "root").join(counts, "node", "left").select("vec", "n", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = lookup(rows, nodes, "vec", "n", "vec_id", rows.count())
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
