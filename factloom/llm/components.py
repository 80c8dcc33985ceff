"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._common import join_counted, staged


def _large_star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node it sees."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("low"), "n")
    # staged, so that hubs, which hold many edges, are known by their counts and join by a bounded broadcast
    return (
        join_counted(both, staged(spark, low, "lows"), ["u"], "n")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them (edges run from large to small)."""
    edges = staged(spark, edges, "edges")
    low = staged(spark, edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), "lows")
    moved = join_counted(edges, low, ["u"], "n").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = low.select("u", F.col("low").alias("v"))
    return moved.unionByName(own).distinct()


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u and v, any order); component: its smallest node.

    Each round aggregates and joins on a node; nodes that hold many edges are known by their counts and go by a
    broadcast of bounded size.
    Rounds grow with the logarithm of the longest chain. Only a count and a checksum reach the driver.
    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    now = staged(
        spark,
        edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = _digest(now)
    while seen[0]:
        now = staged(spark, _small_star(spark, _large_star(spark, now)), "edges")
        found = _digest(now)
        if found == seen:
            break
        seen = found
    stars = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.unionByName(roots)
