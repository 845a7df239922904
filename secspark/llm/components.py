"""Connected components of a link table, in rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secspark.llm.common import materialise


def _toward_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and all its partners.  The least is found by an
    aggregation with map-side combine; the join back is left to the skew-join split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _toward_least(down)
    return (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (u long, v long) -> (node, component): the least node of each component of two or
    more nodes.  The state is a forest of links; it is written to the shared folder each round,
    and it is final when each node hangs on its root (no link ends at a node that has a link up)."""
    state = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                             .distinct(), "links")
    for _ in range(max_rounds):
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0]:
            break
        state = materialise(small_star(large_star(state)), "links")
        if state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
