"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v); root is the least node it is connected with."""
    held: list[str] = []
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", held)
    by_u = Window.partitionBy("u")
    state = None
    while state != (state := _state(now)):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.col("u"), F.min("v").over(by_u))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.where("u <> v").withColumn("m", F.min("v").over(by_u))
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, held = held, []
        now = materialize(small.distinct(), "edges", held)
        discard(now.sparkSession, before)
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
