"""The trial log as a stream: new JSON files become rows once, whatever fails in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "trial_id string, session_id string, member string, model string, parse_success boolean, target_rank int, finished timestamp"


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Trials out of a folder of JSON lines; a line cut short is dropped."""
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(folder).where("trial_id IS NOT NULL")


def logged(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each trial once to a Parquet log, over all that is there now: of a batch its first record by time, and none
    that the log has already, however long ago it was written. A batch that runs again after a failure adds nothing twice."""

    def append(batch: DataFrame, _: int) -> None:
        first = batch.groupBy("trial_id").agg(F.min_by(F.struct(*batch.columns), F.struct("finished", F.xxhash64(*batch.columns))).alias("r")).select("r.*")
        log = batch.sparkSession.read.schema(SCHEMA)
        if _written(batch.sparkSession, out):
            first = first.join(log.parquet(out).select("trial_id"), "trial_id", "left_anti").select(*batch.columns)
        first.write.mode("append").parquet(out)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def hourly(rows: DataFrame) -> DataFrame:
    """Trials, failures and mean reciprocal rank by member and hour; later records than a day don't count."""
    ok = F.col("parse_success") & (F.col("target_rank") >= 1)
    by = rows.withWatermark("finished", "1 day").groupBy(F.window("finished", "1 hour"), "member")
    return by.agg(F.count("*").alias("trials"), F.count_if(~F.coalesce("parse_success", F.lit(False))).alias("failed"), F.avg(F.when(ok, 1 / F.col("target_rank"))).alias("mrr"))
