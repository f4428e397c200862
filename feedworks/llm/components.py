"""Connected components by alternating stars, one stored edge table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedworks.llm.shared import stored
from feedworks.sources.storage import delete, scratch_path

MAX_ROUNDS = 60


def _nearest(edges: DataFrame) -> DataFrame:
    """Each ``u`` with the smallest node among itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("low")).select(
        "u", F.least("u", "low").alias("low")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_nearest(both), "u").filter("v > u AND v <> low")
    return linked.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point down (u > v): hang all lower neighbours on the lowest."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.withColumnRenamed("low", "v")).filter(
        "u > v"
    ).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for nodes with links.

    ``edges`` holds pairs of longs ``u`` and ``v``; order, repeats and loops do
    not matter. Minima are taken before the shuffle and the joins may be split,
    so a hub with many neighbours does not land in one task. Every round is a
    written table, and only a count and a checksum return to the driver.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    ordered = edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = stored(ordered.distinct(), "edges", path)
    state = None
    for _ in range(MAX_ROUNDS):
        now = current.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")
        ).first()
        if now == state or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, old = now, path
        path = scratch_path(spark, "edges")
        current = stored(_small_star(_large_star(current)), "edges", path)
        delete(spark, old)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
