"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialise


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v) → (u, v, m), m the smallest of u and its v; the minimum is pre-aggregated, and the join
    back is left to adaptive skew splitting, for a hub may have many neighbours."""
    low = pairs.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__v"))
    return pairs.join(low, F.col("u") == F.col("__u")).select("u", "v", F.least("u", "__v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    linked = _lowest(both.toDF("u", "v"))
    return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _lowest(down)
    to_low = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
    return to_low.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs → (node, component) for every node of an edge; component is the
    smallest node reachable. Each round is a written table, so lineage stays short. The edges
    have settled when a round leaves the same stars: then every u points at its component."""
    state = materialise(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = materialise(small_star(large_star(state)), "stars")
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select(F.col("v"), F.col("v")).distinct())
