"""Connected components of an edge table, by alternating large and small stars.

Every step is a map-side-combined minimum per vertex and a join back, so a vertex
with very many edges is never gathered in one place; the edges stay in Spark and
each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import write_once


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: each vertex sends its larger neighbours to its minimum. Small
    star: each vertex sends its smaller neighbours and itself to its minimum."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = (both.where("b > a") if larger else both).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(v, component) of every vertex with an edge to another; ``component`` is its
    component's smallest vertex. ``edges`` has columns a and b, any direction."""
    now = write_once(edges.where("a <> b").select("a", "b").distinct(), label)
    seen = None
    while True:
        now = write_once(_star(_star(now, True), False), label)
        stars = now.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("s"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(stars) == seen:
            return now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
        seen = tuple(stars)
