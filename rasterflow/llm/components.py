"""Connected components by alternating star contractions, over tables of links; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.llm.common import staged, unstage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction. Large star: neighbours greater than a node go to its least neighbour; small star: the others do."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("m").alias("u"), "v")
    else:
        out = joined.where("v <> m").select(F.col("m").alias("u"), "v").unionByName(least.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where("u <> v").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) already are stars around their least nodes: no v hangs twice, and no u hangs itself."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("hangs")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("hangs"))
    )
    return roles.groupBy("node").agg(F.max("centre").alias("c"), F.sum("hangs").alias("h")).where("h > 1 OR h = 1 AND c = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node that a link (u, v) names; label is the least node of its component."""
    edges = staged(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not settled(edges):
        new = staged(_star(_star(edges, True), False), "edges")
        unstage(edges)
        edges = new
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
