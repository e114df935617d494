"""Distributed connected components by alternating large-star and small-star rounds.

Published as a MapReduce algorithm (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014). Edges stay in DataFrames; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.llm._spark import Stage

MAX_ROUNDS = 60


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star round over edges (a > b). both: large star, else small star."""
    near = edges
    if both:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = near.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select(F.col("a"), F.least("a", "m").alias("m"))
    joined = near.join(low, "a")
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b) of longs.

    Self-loops and null ends are ignored, repeated edges count once, no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stage.save(e, f"{name}-0")
    for i in range(1, MAX_ROUNDS):
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        tangled = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)")
        if not tangled.limit(1).count():  # every node has one centre, and no centre has another
            break
        e = stage.save(_star(_star(e, True), False), f"{name}-{i}")
        stage.drop(f"{name}-{i - 1}")
    else:
        raise RuntimeError("connected components did not settle")
    low = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(low)
