"""Connected components of an edge table, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialise, release


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step: each node hands its smallest neighbour (itself included) to its larger (large) or smaller neighbours.

    The rows of a hub are dealt over the join by ``lookup``. Least neighbours and result are written, so that no plan
    holds a step twice: Spark's driver keeps and rewrites a plan as a whole while its stages run.
    """
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialise(sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    out = lookup(sides, least, "u", "n", "v", 2 * total)
    if large:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = materialise(out.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    release(edges, least)
    return out


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges (a, b), and whether they are stars: each a has one edge, and is no other edge's b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    total, most = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.max(F.when(F.col("up") > 0, F.col("up") + F.col("down")))).first()
    return total, (most or 1) == 1


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the smallest node of the component, for each node that has an edge.

    Alternates large-star and small-star steps until the edges are stars around the roots, which a further round wouldn't
    change; each step is written to the shared folder, so lineage stays short, and takes the place of the one before.
    Nulls in an edge and loops are left out; an empty edge table gives no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a != b")
    pairs = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not (state := _state(pairs))[1]:
        pairs = _star(_star(pairs, True, state[0]), False, state[0])
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
