"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.plans.lineage import Scratch
from telar.plans.skew import BROADCAST_ROWS, join_counted


def _nearest(pairs: DataFrame, scratch: Scratch, at_most: int) -> DataFrame:
    """Each node's smallest neighbour or itself, and its number of neighbours: combined before the shuffle, written unless it is small."""
    near = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
    return near if at_most <= BROADCAST_ROWS else scratch.cut(near, "near")


def _large_star(edges: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _nearest(both, scratch, 2 * size)
    out = join_counted(both, near, ["u"], "n", 2 * size, 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    near = _nearest(edges, scratch, size)
    moved = join_counted(edges, near, ["u"], "n", size, size).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (its smallest node) for every node of an edge ``a``-``b``.

    Every round replaces edges by edges to smaller nodes; the rounds end when nothing changes, after a number of rounds that grows
    with the logarithm of the longest chain.  A node with very many neighbours is never gathered in one task: minima are combined
    before the shuffle and the join back to the edges spreads such nodes.  Each round is written to the shared folder; whether it changed
    anything is seen while it is written.  Null ends and loops are dropped; an empty input gives an empty result.
    """
    marks = (F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
    e = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, now = scratch.cut_counted(e, "edges", *marks)
    state = None
    for _ in range(max_rounds):
        if now["n"] == 0 or now == state:
            break
        state = now
        wide = scratch.cut(_large_star(current, scratch, now["n"]), "large")
        # as many edges as before at most: a large star moves edges and makes none
        following, now = scratch.cut_counted(_small_star(wide, scratch, now["n"]), "small", *marks)
        scratch.discard(current)
        scratch.discard(wide)
        current = following
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
