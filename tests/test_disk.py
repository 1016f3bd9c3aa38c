"""What must not be on disk at once: users of all asked item pairs, shuffles of rankers, runs and weights together."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionforge.operators import evaluation, rankers, trials
from sessionforge.plans import reports
from sessionforge.sources import scratch
from sessionforge.sources.scratch import saved


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def _case(spark):
    e = spark.range(40).select(F.col("id").alias("user_id"), F.explode(F.expr("transform(sequence(0, 8), i -> (id * id + i * i * 3 + id * i) % 30)")).alias("item_id")).distinct()
    e = saved(e.unionByName(spark.range(40).select(F.col("id").alias("user_id"), F.lit(30).cast("long").alias("item_id"))))  # an item of all users
    pools = saved(spark.range(12).select(F.concat(F.lit("user-"), "id").alias("session_id"), F.explode(F.expr("transform(sequence(0, 5), i -> (id * 7 + i * 11) % 31)")).alias("item_id")).distinct())
    past = saved(spark.range(12).select(F.concat(F.lit("user-"), "id").alias("session_id"), F.posexplode(F.expr("transform(sequence(0, 6), i -> (id * 3 + i * i) % 31)")).alias("back", "past")))
    return e, pools, past


def _rows(df):
    return sorted((r["session_id"], r["item_id"], r["past"], r["back"], round(r["cosine"], 9)) for r in df.collect())


def _brute(e, pools, past):
    users = {}
    for r in e.collect():
        users.setdefault(r["item_id"], set()).add(r["user_id"])
    out = []
    histories = past.collect()
    for p in pools.collect():
        for h in [h for h in histories if h["session_id"] == p["session_id"]]:
            a, b = users.get(p["item_id"], set()), users.get(h["past"], set())
            if a & b:
                out.append((p["session_id"], p["item_id"], h["past"], h["back"], round(len(a & b) / (len(a) ** 0.5 * len(b) ** 0.5), 9)))
    return sorted(out)


def test_users_of_item_pairs_are_never_rows(spark):
    e, pools, past = _case(spark)
    out = rankers.knn_scores(pools, past, e)
    assert "user_id" not in _plan(out)  # lists of users travel; a row for each user of each pair was a hundred times the tables
    assert _rows(out) == _brute(e, pools, past)


def test_rounds_and_long_items_give_the_same_scores(spark, monkeypatch):
    e, pools, past = _case(spark)
    whole = _brute(e, pools, past)
    monkeypatch.setattr(rankers, "AT_ONCE", 200)
    assert _rows(rankers.knn_scores(pools, past, e)) == whole
    for most in (0, 8, 20):
        monkeypatch.setattr(rankers, "LISTED", most)
        assert _rows(rankers.knn_scores(pools, past, e)) == whole


def test_rounds_are_all_of_the_rows(spark, monkeypatch):
    rows = spark.range(50).select(F.concat(F.lit("user-"), "id").alias("session_id"), "id")
    writes = []
    monkeypatch.setattr(scratch, "saved", lambda df: (writes.append(1), saved(df))[1])
    out = scratch.in_rounds(4, lambda part: part(rows).select("id"))
    assert len(writes) == 4 and sorted(r["id"] for r in out.collect()) == list(range(50))
    assert scratch.in_rounds(1, lambda part: part(rows)) is rows


def test_members_and_order_keys_are_added_after_the_deal(spark):
    pools = saved(spark.range(4).select(F.lit("user-1").alias("session_id"), F.col("id").alias("item_id")))
    plan = _plan(trials.presented(pools, trials.MEMBERS))
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning(session_id")  # above it


def test_weights_of_the_grid_never_multiply_items(spark):
    parts = saved(spark.createDataFrame([("s", 1, i, r, float(z), "validation") for r in ("llm", "item_knn") for i, z in ((1, 2), (2, 3))], "session_id string, target long, item_id long, ranker string, z double, split string"))
    grid = evaluation.llm_grid(parts.where("ranker = 'item_knn'"), parts)
    assert "Window" not in _plan(grid)
    assert {(r["method"], r["mrr"]) for r in grid.collect()} == {("item_knn", 0.5)} and grid.count() == len(evaluation.LLM_GRID)


def test_order_mismatches_need_no_ranker(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(reports.Grounding, "ranker_scores", lambda *a: (_ for _ in ()).throw(AssertionError("a ranker was asked")))
    row = reports.grounding_order_mismatches(spark, sf_dir).first()
    assert row["sessions"] > 0 and 0 <= row["moved"] <= row["sessions"]
