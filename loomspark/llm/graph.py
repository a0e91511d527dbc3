"""Connected components of an edge list, by alternating large and small stars.

Each round replaces edges by edges to the least neighbour: of larger neighbours (large star), then of smaller ones
(small star). It ends, after about log(n) rounds, with a star around the least node of each component. Each round is
written to the shared folder, so a lost executor costs no more than one round; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's least node) of every node of edges(a long, b long) that isn't a root itself."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    known = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        if state == known or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = state
        now = written(_small(_large(now)), "edges")


def extended(merged: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) after more edges(a, b): only the roots that these bring together are joined anew."""
    root = lambda c: merged.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct()
    between = written(between, "edges-between")
    if between.isEmpty():
        return merged
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = merged.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(kept.unionAll(moved.select(F.col("root").alias("node"), F.col("to").alias("root"))), "components")
