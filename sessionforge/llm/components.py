"""Connected components of an edge table by alternating large and small stars, with nothing but tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are joined to its least one (itself included)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v with v the least node of u's component, for every node u that isn't that least node itself.

    edges: u, v (long), any direction. Least values are pre-aggregated and joins are plain ones that Spark may split,
    so a node with very many edges isn't one task's. Each round is written to the shared folder."""
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        new = saved(_small(_large(now)))
        dropped(now.sparkSession, now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now
