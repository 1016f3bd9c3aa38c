"""Statistics of items and transitions on training rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import numbered
from .sessions import ordered, pairs


def popularity(train: DataFrame) -> DataFrame:
    return train.groupBy("item_id").agg(F.count("*").alias("n"))


def first_seen(train: DataFrame) -> DataFrame:
    return train.groupBy("item_id").agg(F.min("timestamp").alias("first_seen"))


def transitions(train: DataFrame) -> DataFrame:
    return pairs(train).groupBy("previous", "next").agg(F.count("*").alias("n"))


def edges(train: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Distinct (user_id, item_id), of catalog items where one is given."""
    rows = train.select("user_id", "item_id").distinct()
    return rows if catalog is None else rows.join(catalog.select("item_id"), "item_id", "left_semi")


def norms(e: DataFrame) -> DataFrame:
    """sqrt of the number of users of each item."""
    return e.groupBy("item_id").agg(F.sqrt(F.count("*")).alias("norm"))


def quantiles(df: DataFrame, column: str, *shares: float) -> list[float | None]:
    """Interpolated quantiles of a column's values, nulls aside; None without any.

    The values around each place are read off a dense numbering, so no task holds all values."""
    rows = df.select(column).where(F.col(column).isNotNull())
    n = rows.count()
    if not n:
        return [None] * len(shares)
    spots = [(math.floor(s * (n - 1)), s * (n - 1)) for s in shares]
    wanted = sorted({k for low, _ in spots for k in (low, min(low + 1, n - 1))})
    at = {r["n__"]: float(r[column]) for r in numbered(rows, "n__", column, rows=n).where(F.col("n__").isin(wanted)).collect()}
    return [at[low] + (at[min(low + 1, n - 1)] - at[low]) * (spot - low) for low, spot in spots]


def tertile(value: Column, cuts: list[float | None], names: tuple[str, str, str]) -> Column:
    return F.when(value <= F.lit(cuts[0]), names[0]).when(value <= F.lit(cuts[1]), names[1]).when(value.isNotNull(), names[2])


def audience(pop: DataFrame) -> DataFrame:
    """niche, moderate or popular by tertiles of the items' counts (interpolated)."""
    return pop.select("item_id", "n", tertile(F.col("n"), quantiles(pop, "n", 1 / 3, 2 / 3), ("niche", "moderate", "popular")).alias("audience"))


def trend(train: DataFrame, least: int = 5) -> DataFrame:
    """rising, steady or falling: an item's share of rows in the last quarter of time against the share over all."""
    rows = train.withColumn("late", F.col("timestamp") >= F.lit(quantiles(train, "timestamp", 0.75)[0]))
    share = rows.agg(F.avg(F.col("late").cast("int")).alias("all"))
    by = rows.groupBy("item_id").agg(F.count("*").alias("n"), F.avg(F.col("late").cast("int")).alias("own")).join(F.broadcast(share))
    ratio = F.round(F.col("own") / F.col("all"), 9)
    return by.select("item_id", "n", F.when(F.col("n") < least, "n/a").when(ratio > 1.5, "rising").when(ratio < 0.5, "falling").otherwise("steady").alias("trend"))


def price_tier(items: DataFrame) -> DataFrame:
    """low, mid or high by tertiles of the prices above 0; null without a price."""
    cuts = quantiles(items.where("price > 0"), "price", 1 / 3, 2 / 3)
    return items.select("item_id", F.when(F.col("price") > 0, tertile(F.col("price"), cuts, ("low", "mid", "high"))).alias("tier"))


def gaps(df: DataFrame) -> DataFrame:
    """Shares of a user's gaps of 0 seconds and of more than a day."""
    gap = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy("user_id").orderBy(*ordered(df)))
    rows = df.select(gap.alias("gap")).where("gap IS NOT NULL")
    return rows.agg(F.round(F.avg(F.when(F.col("gap") == 0, 1.0).otherwise(0.0)), 4).alias("same_second"), F.round(F.avg(F.when(F.col("gap") > 86400, 1.0).otherwise(0.0)), 4).alias("over_a_day"))


def midrank(counts: Column, own: Column) -> Column:
    """1 + items below + half the other ties, among an array of counts that holds the target's own."""
    less = F.size(F.filter(counts, lambda c: c < own))
    tied = F.size(F.filter(counts, lambda c: c == own)) - 1
    return 1 + less + tied / 2
