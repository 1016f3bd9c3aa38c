"""What the driver must not gather: rows that arrays were exploded to look small by the file behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionforge.operators import context, ensemble, pools, rankers
from sessionforge.plans import registry
from sessionforge.plans.context import Shown
from sessionforge.sources import tables
from sessionforge.sources.scratch import saved


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def _examples(spark, n: int = 30):
    rows = [(f"user-{u}", u, "test", [(u + i) % 40 for i in range(6)], (u + 6) % 40) for u in range(n)]
    return saved(spark.createDataFrame(rows, "session_id string, user_id long, split string, prefix array<long>, target long"))


def test_histories_and_draws_of_random_pools_are_dealt(spark, monkeypatch):
    examples, catalog = _examples(spark), saved(spark.range(40).select(F.col("id").alias("item_id")))
    plans = []
    monkeypatch.setattr(pools, "saved", lambda df: (plans.append(_plan(df)), saved(df))[1])
    rows = pools.random_pools(examples, catalog)
    assert "Generate explode" in plans[0]
    assert plans[0].count("BroadcastHashJoin") == 0 and plans[0].count("SortMergeJoin") == 2
    assert rows.groupBy("session_id").agg(F.count_distinct("item_id").alias("n")).where("n = 20").count() == 30


def test_exploded_rows_are_dealt_in_rankers_and_contexts(spark):
    examples = _examples(spark)
    items = saved(spark.range(40).select(F.col("id").alias("item_id"), F.lit("t").alias("title"), F.array(F.lit("g")).alias("genres"), F.lit("none").alias("series"), F.lit("year=1").alias("year")))
    some = saved(spark.range(5).select(F.concat(F.lit("user-"), "id").alias("session_id"), F.col("id").alias("item_id")))
    assert "BroadcastHashJoin" not in _plan(some.join(rankers.history_rows(examples, 50), "session_id"))
    shown = examples.withColumn("candidates", F.col("prefix"))
    assert "BroadcastHashJoin" not in _plan(context.content(shown, items, examples))


def test_many_rows_of_small_files_are_dealt(spark):
    """Negatives and answers: their files are a hundredth of what they are in memory."""
    examples = _examples(spark)
    negatives = saved(examples.select("session_id", F.explode("prefix").alias("item_id")))
    plan = _plan(pools.with_target(negatives, examples))
    assert "SortMergeJoin [session_id" in plan  # the sessions that have any may still be sent
    rows = examples.select("session_id", "split", "target", F.posexplode("prefix").alias("position", "item_id"))
    answers = saved(rows.crossJoin(spark.createDataFrame([("a:title",), ("b:genre",)], "member string")).withColumn("score", F.col("position").cast("double")).withColumn("slot", F.col("position")))
    weights = saved(answers.select("session_id", "member").distinct().withColumn("weight", F.lit(0.5)))
    assert "BroadcastHashJoin" not in _plan(ensemble.weighted(answers, weights))
    assert "BroadcastHashJoin" not in _plan(rankers.session_metrics(answers.select("session_id", "member", "item_id", "score"), examples, "member"))


def test_tables_of_all_items_and_orders_are_dealt(spark, sf_dir):
    """Item features have a part for each field, and interactions all orders: none goes through the driver."""
    train = saved(tables.interactions(spark, sf_dir))
    items, meta = saved(tables.items(spark, sf_dir)), tables.item_meta(spark, sf_dir)
    assert "BroadcastHashJoin" not in _plan(tables.interactions(spark, sf_dir))
    assert "BroadcastHashJoin" not in _plan(context.item_features(train, saved(train.groupBy("item_id").agg(F.count("*").alias("n"))), items, meta))


def test_agreements_of_all_sessions_are_dealt(spark):
    examples = _examples(spark)
    rows = examples.select("session_id", "split", "target", F.posexplode("prefix").alias("position", "item_id"))
    answers = saved(rows.crossJoin(spark.createDataFrame([("a:title",), ("b:genre",)], "member string")).withColumn("score", F.col("position").cast("double")))
    assert "BroadcastHashJoin" not in _plan(ensemble.reliability(answers))


def test_histories_and_pools_of_contexts_are_dealt(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(registry, "saved", lambda df: (plans.append(_plan(df)), saved(df))[1])
    Shown(spark, sf_dir)
    assert "BroadcastHashJoin" not in plans[-1]
