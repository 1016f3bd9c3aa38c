"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of a write after which its shuffle files are worth a collection of the driver's memory.
LONG = 15


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sessionforge-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again with its schema. What a long write shuffled is let go."""
    spark, path, began = df.sparkSession, scratch_dir(df.sparkSession), time.monotonic()
    df.write.parquet(path)
    if time.monotonic() - began > LONG:
        freed(spark)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, times: int = 3) -> None:
    """Lets Spark delete shuffle files of jobs that have ended: its cleaner acts when the driver's memory is collected.
    The first collection still finds the last job referred to."""
    for i in range(times):
        if i:
            time.sleep(1)
        gc.collect()
        spark._jvm.System.gc()


def in_rounds(rounds: int, build: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], by: str = "session_id") -> DataFrame:
    """build(part) for so many shares of the rows' `by` in turn, each saved before the next one begins, so that a share's
    shuffles alone are on disk; all shares together are the result. part(df) is the rows of df in the share. One round is
    not saved."""
    if rounds <= 1:
        return build(lambda df: df)
    out = None
    for i in range(rounds):
        mine: Column = F.pmod(F.xxhash64(by, F.lit("round")), F.lit(rounds)) == i
        rows = saved(build(lambda df, mine=mine: df.where(mine)))
        out = rows if out is None else out.unionByName(rows)
    return out
