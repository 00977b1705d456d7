"""Connected components on an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lymphframe.session import stage, unstage


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "parent"))).first()
    return row[0], row[1]


def _named(state: DataFrame) -> DataFrame:
    roots = state.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    return state.select("node", F.col("parent").alias("root")).union(roots)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node on an edge, root the least node reachable.

    Nodes may be any one orderable type. Null ends and loops are ignored, repeated edges
    counted once; an empty table gives an empty result. Nodes without an edge don't appear:
    left-join and coalesce. Each round is written to the shared folder, so a lost executor
    costs a round at most; minima are combined before the shuffle, and the joins back to a
    hub's neighbours are plain equi-joins that adaptive execution can split.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a") != F.col("b"))
    state = stage(e.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).distinct(), "edges")
    before = _digest(state)
    if before[0] == 0:
        return _named(state)
    for _ in range(max_rounds):
        both = state.select(F.col("node").alias("u"), F.col("parent").alias("v")).union(state.select("parent", "node"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("node"), F.col("m").alias("parent")).distinct()
        least = large.groupBy("node").agg(F.min("parent").alias("m"))
        moved = large.join(least, "node").where(F.col("parent") != F.col("m")).select(F.col("parent").alias("node"), F.col("m").alias("parent"))
        new = stage(moved.union(least.select("node", F.col("m").alias("parent"))).distinct(), "round")
        after = _digest(new)
        unstage(state)
        state = new
        if after == before:
            return _named(state)
        before = after
    raise RuntimeError("connected components did not settle")
