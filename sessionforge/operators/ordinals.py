"""Dense numbers in a total order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = 256


def numbered(df: DataFrame, name: str, *order: str, rows: int | None = None) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... in ascending order of the columns.

    The first column's range is cut at a hash sample of its values (about CUTS of them); a count for each range and
    its prefix sum give where a range begins, and only ranges are sorted. Rows that agree in all columns are numbered
    in any order."""
    key = order[0]
    n = df.count() if rows is None else rows
    every = max(1, n // CUTS)
    cuts = sorted(r[0] for r in df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(*order), F.lit(every)) == 0)).select(key).distinct().collect()) if n > 4096 else []
    cuts = cuts[:: max(1, len(cuts) // CUTS)]
    if not cuts:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    values = F.array(*[F.lit(c) for c in cuts])
    part = F.size(F.filter(values, lambda c: c <= F.col(key)))
    df = df.withColumn("part__", F.coalesce(part, F.lit(0)))
    counts = df.groupBy("part__").agg(F.count("*").alias("n__"))
    base = counts.withColumn("base__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    df = df.join(F.broadcast(base), "part__")  # a row for each of at most 2 * CUTS ranges
    inside = F.row_number().over(Window.partitionBy("part__").orderBy(*order)) - 1
    return df.withColumn(name, (F.col("base__") + inside).cast("long")).drop("part__", "base__")


def id_map(df: DataFrame, column: str, name: str) -> DataFrame:
    """column and `name`: 1, 2, 3 ... by sorted distinct value."""
    return numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), "n__", column).select(column, (F.col("n__") + 1).cast("int").alias(name))
