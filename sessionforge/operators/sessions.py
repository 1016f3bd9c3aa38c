"""Histories, leave-one-out examples and clean examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import uniform_hash
from ..sources.tables import TIES, require

MIN_HISTORY, POSITIVE = 3, 4.0
VALIDATION, SEED = 0.3, 0
POOL = 20


def ordered(df: DataFrame) -> Column:
    """The columns that order a user's rows in full."""
    return [c for c in ("timestamp", "item_id", *TIES) if c in df.columns]


def histories(df: DataFrame) -> DataFrame:
    """user_id and h, the user's rows (timestamp, item_id, ..., rating) in order: one shuffle on the user."""
    require(df, "user_id", "item_id", "timestamp")
    cols = ordered(df)
    rest = [c for c in ("rating",) if c in df.columns]
    return df.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*cols, *rest))).alias("h"))


def training(df: DataFrame) -> DataFrame:
    """All rows but each user's last one."""
    last = Window.partitionBy("user_id").orderBy(*[F.desc(c) for c in ordered(df)])
    return df.withColumn("n__", F.row_number().over(last)).where("n__ > 1").drop("n__")


def split_of(session: Column, fraction: float = VALIDATION, seed: int = SEED) -> Column:
    """validation or test by the session's hash."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must be in [0, 1)")
    return F.when(uniform_hash(F.lit(seed), session) < fraction * 2**32, "validation").otherwise("test")


def split_by_crc(session: Column, fraction: float = VALIDATION, seed: int = SEED) -> Column:
    """The same by crc32, which has no SQL twin."""
    return F.when(F.crc32(F.concat(F.lit(f"{seed}:"), session).cast("binary")) / 4294967296.0 < fraction, "validation").otherwise("test")


def _examples(df: DataFrame) -> DataFrame:
    items = F.transform("h", lambda r: r["item_id"])
    n = F.size("h")
    last = F.element_at("h", -1)
    return histories(df).select("user_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"), n.alias("n"), F.slice(items, F.lit(1), n - 1).alias("prefix"), last["item_id"].alias("target"), last["timestamp"].alias("target_timestamp"), F.when(n > 1, F.element_at("h", -2)["timestamp"]).alias("before_timestamp"), *([last["rating"].alias("target_rating")] if "rating" in df.columns else []))


def leave_one_out(df: DataFrame, min_history: int = MIN_HISTORY, max_history: int | None = None, strict: bool = True) -> DataFrame:
    """session_id, prefix, target and target_timestamp of users with more than min_history rows. The prefix is cut to
    its last max_history items first; strict refuses a target in what is left, else the row is dropped."""
    rows = _examples(df).where(F.col("n") > min_history)
    if max_history:
        rows = rows.withColumn("prefix", F.slice("prefix", F.greatest(F.size("prefix") - max_history, F.lit(0)) + 1, max_history))
    leak = F.array_contains("prefix", F.col("target"))
    if strict:
        rows = rows.withColumn("target", F.when(leak, F.raise_error(F.concat(F.lit("target in history of "), "session_id")).cast("long")).otherwise(F.col("target")))
    else:
        rows = rows.where(~leak)
    return rows.select("user_id", "session_id", "prefix", "target", "target_timestamp")


def judged(df: DataFrame, min_history: int = MIN_HISTORY, positive: float = POSITIVE) -> DataFrame:
    """Examples with drop_reason, the first rule that a user breaks: short, non_positive, tied, in_history; null if clean."""
    reason = (
        F.when(F.col("n") <= min_history, "short").when(F.col("target_rating") < positive, "non_positive")
        .when(F.col("target_timestamp") == F.col("before_timestamp"), "tied").when(F.array_contains("prefix", F.col("target")), "in_history")
    )
    return _examples(df).withColumn("drop_reason", reason)


def clean(df: DataFrame) -> DataFrame:
    """Clean examples with their split."""
    rows = judged(df).where("drop_reason IS NULL").drop("drop_reason", "n", "before_timestamp")
    return rows.withColumn("split", split_of(F.col("session_id")))


def pairs(df: DataFrame) -> DataFrame:
    """Consecutive (previous, next) items of each user. Rows that agree in time and item are the same item in any order,
    so the columns that break their ties don't travel."""
    order = Window.partitionBy("user_id").orderBy("timestamp", "item_id")
    return df.select("user_id", "timestamp", "item_id").withColumn("next", F.lead("item_id").over(order)).where("next IS NOT NULL").select(F.col("item_id").alias("previous"), "next")


def recent(prefix: Column, n: int) -> Column:
    """The last n items."""
    return F.slice(prefix, F.greatest(F.size(prefix) - n, F.lit(0)) + 1, n)


def exploded(rows: DataFrame) -> DataFrame:
    """Rows that arrays or sequences were exploded to, or many rows of a saved frame, for joins: dealt, never broadcast.
    Spark goes by the size of the file behind them, in which repeats take next to no room, and would gather millions of
    rows in the driver. A join that isn't hinted anew forgets it."""
    return rows.hint("merge")


def k_core(df: DataFrame, k: int, checkpoint) -> DataFrame:
    """Rows left when items and then users with fewer than k rows are dropped until nothing changes.

    checkpoint writes a table to the shared folder and reads it again, which cuts the loop's lineage."""
    now, n = checkpoint(df), None
    while True:
        by_item = now.groupBy("item_id").agg(F.count("*").alias("n__")).where(F.col("n__") >= k).select("item_id")
        now = now.join(by_item, "item_id", "left_semi")
        by_user = now.groupBy("user_id").agg(F.count("*").alias("n__")).where(F.col("n__") >= k).select("user_id")
        now = checkpoint(now.join(by_user, "user_id", "left_semi"))
        before, n = n, now.count()
        if n == before or not n:
            return now
