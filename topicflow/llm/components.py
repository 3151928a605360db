"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _min_neighbour(links: DataFrame) -> DataFrame:
    """Least of each ``u`` and its neighbours; partial minima keep hot vertices cheap."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """``vertex, component`` (the least vertex reachable) of every vertex that a link names.

    ``edges`` has ``a`` and ``b``; nulls and loops are skipped, no edges give no rows. Every round is
    written below ``folder``, which all executors share, so lineage stays short and a lost executor
    costs one round. Each star step groups by a vertex with partial minima and joins the minimum
    back, so the neighbours of no vertex are ever collected; the number of rounds grows with the logarithm
    of the component size.
    """
    spark = edges.sparkSession
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    schema = "u LONG, v LONG"
    now.distinct().write.parquet(f"{folder}/0")
    before, turn = None, 0
    while True:
        now = spark.read.schema(schema).parquet(f"{folder}/{turn}")
        links = _both_ways(now)
        # large star: neighbours above a vertex move to its least neighbour
        large = links.join(_min_neighbour(links), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        # small star: a vertex and its neighbours below it move to the least of them
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        turn += 1
        small.where("u != v").distinct().write.parquet(f"{folder}/{turn}")
        now = spark.read.schema(schema).parquet(f"{folder}/{turn}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
