"""Hand-computed values, invariants and refusals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionforge.functions import metrics as m
from sessionforge.functions import text as tx
from sessionforge.operators import ensemble, ordinals, pools, sessions, trials
from sessionforge.operators import statistics as st
from sessionforge.plans.registry import Bench
from sessionforge.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_random_expectations(spark):
    r = spark.createDataFrame([(20,), (3,)], "n int").select("n", *[v.alias(k) for k, v in m.expected_random(F.col("n")).items()]).collect()
    big, small = sorted(r, key=lambda x: -x["n"])
    assert (big["hr1"], big["hr5"], big["hr10"]) == (0.05, 0.25, 0.5)
    assert round(big["ndcg5"], 6) == 0.147423 and round(big["ndcg10"], 6) == 0.227178
    assert (round(small["hr1"], 6), small["hr5"], small["hr10"]) == (0.333333, 1.0, 1.0)


def test_tie_aware(spark):
    out = spark.range(1).select(*[v.alias(k) for k, v in m.tie_aware(F.lit(0), F.lit(1)).items()]).first()
    assert (out["rr"], out["hr1"]) == (0.75, 0.5)


def test_midrank(spark):
    from sessionforge.operators.popularity import midrank

    assert one(spark, midrank(F.array(F.lit(5), F.lit(5), F.lit(1), F.lit(9)), F.lit(5))) == 2.5


def test_holm(spark):
    rows = st.holm(spark.createDataFrame([(0.01,), (0.04,), (0.5,)], "p double"), "p").orderBy("p").collect()
    assert [round(r["p_holm"], 9) for r in rows] == [0.03, 0.08, 0.5]


def test_power():
    import math

    assert st.required_sessions(0.5) == math.ceil(((1.959964 + 0.841621) / 0.5) ** 2 / 0.864)
    assert 0.79 < st.achieved_power(0.5, st.required_sessions(0.5)) < 0.83


def test_statistics():
    assert st.wilcoxon(np.zeros(5)) == (None, None)
    stat, p = st.wilcoxon(np.array([1.0, 2, 3, 4, 5, 6]))
    assert stat == 0 and p == pytest.approx(2 / 64)
    mean, low, high = st.paired_bootstrap(np.arange(100.0))
    assert low < mean < high and mean == 49.5
    assert st.sign_flip(np.ones(20)) < 0.01 < st.sign_flip(np.tile([1.0, -1.0], 10))


def test_responses(spark):
    rows = [
        ([30, 40, 50], 50, '{"scores":[20,90,10]}', None, 3), ([30, 40], 40, '{"scores":[20,true]}', "bad score", None), ([30, 40], 40, '{"scores":[20,"9"]}', "bad score", None),
        ([30, 40], 40, '{"scores":[20,101]}', "bad score", None), ([30, 40], 40, '{"scores":[20]}', "wrong length", None), ([30, 30], 30, '{"scores":[1,2]}', "duplicate candidates", None),
        ([], 30, '{"scores":[]}', "no candidates", None), ([30], 40, '{"scores":[5]}', "target missing", None), ([30], 30, "oops", "invalid JSON", None), ([30], 30, '{"scores":[1],"x":2}', "wrong keys", None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "candidates array<long>, target long, response string")
    got = {r["response"] + str(r["candidates"]): r for r in trials.parsed(df).collect()}
    for c, _, text, error, rank in rows:
        r = got[text + str(c)]
        assert r["parse_error"] == error, text
        assert r["target_rank"] == rank
    assert got['{"scores":[20,90,10]}[30, 40, 50]']["ranked"] == [40, 30, 50]


def test_text_rules(spark):
    assert one(spark, tx.clean_format(F.lit("DVD-R  This title is"))) == "DVD-R" and one(spark, tx.clean_format(F.lit("Unknown Binding"))) == ""
    assert one(spark, tx.store_format(F.lit("Band (Artist)  Format: Vinyl"))) == "Vinyl"
    got = one(spark, tx.subgenre_below(F.array(*map(F.lit, ["Music", "Rock", "Deals", "Punk", "Ska Punk"])), ["Rock"]))
    assert (got["subgenre"], got["family"]) == ("Ska Punk", "Punk")
    assert one(spark, tx.runtime_minutes(F.lit("1 hour and 42 minutes"))) == 102 and one(spark, tx.runtime_minutes(F.lit("n/a"))) is None
    kinds = [("Show Season 2", [], None, "tv"), ("Film", ["Movies"], None, "movie"), ("Show Season 1", ["Movies"], None, None), ("Clip", [], 10, None), ("Long", [], 300, "tv"), ("Big Collection", [], 300, None), ("Film", [], 100, "movie")]
    for title, labels, minutes, want in kinds:
        assert one(spark, tx.media_type(F.lit(title), F.array(*map(F.lit, labels)).cast("array<string>"), F.lit(minutes).cast("int"))) == want
    assert one(spark, tx.creator(F.lit(None).cast("string"), F.lit("Ada  Holm  (Pianist),  Quartet (X)    Format: Audio CD"))) == "Ada Holm"
    assert one(spark, tx.short(F.lit("x" * 50))) == "x" * 39 + "…" and one(spark, tx.ordinal_text(F.lit(4))) == "4th most recent"
    assert one(spark, tx.display_title(F.lit("A"), F.lit(""))) == "A" and one(spark, tx.long_tail_weight(F.lit(5), F.lit(5), F.lit(50))) == 0.7


def test_sessions(spark):
    rows = spark.createDataFrame([(1, 10, 1, 5.0), (1, 11, 2, 5.0), (1, 12, 3, 5.0), (1, 13, 4, 5.0), (2, 10, 1, 5.0)], "user_id int, item_id int, timestamp long, rating double")
    got = sessions.leave_one_out(rows, max_history=2).collect()
    assert [(r["session_id"], r["prefix"], r["target"]) for r in got] == [("user-1", [11, 12], 13)]
    assert sorted(r["item_id"] for r in sessions.training(rows).collect()) == [10, 11, 12]
    leak = rows.union(spark.createDataFrame([(1, 10, 9, 5.0)], rows.schema))
    with pytest.raises(Exception, match="target in history"):
        sessions.leave_one_out(leak).collect()
    with pytest.raises(ValueError):
        sessions.split_of(F.col("x"), 1.0)
    with pytest.raises(ValueError):
        tables.require(rows, "missing")


def test_k_core(spark):
    rows = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "b"), ("u3", "c")], "user_id string, item_id string")
    keep = lambda k: {r["item_id"] for r in sessions.k_core(rows, k, lambda d: d.cache()).collect()}
    assert keep(2) == {"a", "b"} and keep(3) == set()


def test_numbered(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("v"))
    got = ordinals.numbered(df, "n", "v").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(20_000))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got)


def test_pools_are_fair(spark):
    b = Bench(spark, "/root/testdata/sf0.01")
    for made in (b.random(), b.matched()):
        by = made.groupBy("session_id").agg(F.count_distinct("item_id").alias("n"), F.max((F.col("item_id") == F.col("target")).cast("int")).alias("t"), F.max("position").alias("p"))
        assert by.where("n <> 20 OR t <> 1 OR p <> 19").isEmpty()
        assert made.join(b.clean.select("session_id", "prefix"), "session_id").where(F.array_contains("prefix", F.col("item_id"))).isEmpty()
    mean = pools.midranks(b.matched(), b.pop).agg(F.avg("midrank")).first()[0]
    assert abs(mean - 10.5) < 0.8


def test_drop_reasons_at_all_sizes(spark):
    want = {"sf0.001": (0, 80, 1, 10, 59), "sf0.01": (2, 914, 5, 12, 567)}
    for sf, (short, low, tied, seen, ok) in want.items():
        got = {r["reason"]: r["n"] for r in sessions.judged(tables.interactions(spark, f"/root/testdata/{sf}")).groupBy(F.coalesce("drop_reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("n")).collect()}
        assert tuple(got.get(k, 0) for k in ("short", "non_positive", "tied", "in_history", "clean")) == (short, low, tied, seen, ok)


def test_zscore_and_llm_weight(spark):
    rows = spark.createDataFrame([("s", "m", i, 3.0) for i in range(4)], "session_id string, member string, item_id int, score double")
    assert {r["z"] for r in ensemble.zscored(rows, "member").collect()} == {0.0}
    assert ensemble.best_llm_weight([(0.0, 0.5), (0.1, 0.5 + 1e-13), (0.2, 0.6), (0.3, 0.6)]) == (0.2, 0.6)
    with pytest.raises(ValueError):
        ensemble.excluded(rows, ["nobody"])


def test_files(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("1::2::5::100\n1::3::4::200\n")
    (tmp_path / "movies.dat").write_bytes("2::Amélie (2001)::Comedy|Romance\n".encode("latin-1"))
    assert tables.read_ratings(spark, str(tmp_path / "ratings.dat")).count() == 2
    assert tables.read_movies(spark, str(tmp_path / "movies.dat")).first()["title"] == "Amélie (2001)"
    (tmp_path / "raw.csv").write_text("user_id,parent_asin,rating,timestamp\nu,B1,5.0,1999\nv,B2,4.0,2000\n")
    raw = tables.read_raw_ratings(spark, str(tmp_path / "raw.csv"))
    users, items = ordinals.id_map(raw, "user_id", "new_user_id"), ordinals.id_map(raw, "parent_asin", "item_id")
    assert sorted((r["user_id"], r["item_id"], r["timestamp"]) for r in tables.remapped(raw, users, items).collect()) == [(1, 1, 1), (2, 2, 2)]
    (tmp_path / "meta.json").write_text('{"parent_asin":"B1","title":"","categories":["Video Games","PC"]}\n{"parent_asin":"B9","title":"x"}\n')
    got = tables.game_items(tables.wanted_metadata(spark, str(tmp_path / "meta.json"), items), items).collect()
    assert [(r["item_id"], r["title"], r["genres"]) for r in got] == [(1, "item B1", "Video Games|PC")]
    pop = spark.createDataFrame([(3, 4), (1, 9)], "item_id int, n long")
    tables.write_popularity(pop, str(tmp_path / "pop"))
    assert sorted(map(tuple, tables.read_popularity(spark, str(tmp_path / "pop")).collect())) == [(1, 9), (3, 4)]


def test_random_pools_of_small_catalogs(spark):
    catalog = spark.range(25).select(F.col("id").alias("item_id"))
    examples = spark.createDataFrame([(i, f"user-{i}", [0, 1, 2, 3, 4], 5 + i % 20, "test") for i in range(60)], "user_id long, session_id string, prefix array<long>, target long, split string")
    got = pools.random_pools(examples, catalog).groupBy("session_id").agg(F.count_distinct("item_id").alias("n"), F.min("item_id").alias("least")).collect()
    assert len(got) == 60 and all(r["n"] == 20 and r["least"] == 5 for r in got)  # exactly 19 negatives exist
    with pytest.raises(Exception, match="not enough eligible negatives"):
        pools.random_pools(examples, catalog.limit(24)).collect()


def test_targets_outside_the_catalog(spark):
    catalog = spark.range(100).select(F.col("id").alias("item_id"))
    pop = spark.range(101).select(F.col("id").alias("item_id"), F.when(F.col("id") == 100, 50).otherwise(F.col("id")).cast("long").alias("n"))
    examples = spark.createDataFrame([(1, "user-1", [7, 8], 100, "test"), (2, "user-2", [7], 60, "test")], "user_id long, session_id string, prefix array<long>, target long, split string")
    got = {r["session_id"]: r["items"] for r in pools.popularity_matched_pools(examples, pop, catalog).groupBy("session_id").agg(F.collect_list("item_id").alias("items")).collect()}
    assert len(got["user-1"]) == len(got["user-2"]) == 20 and 100 in got["user-1"]
    assert all(abs(i - 50) <= 60 for i in got["user-1"] if i != 100)


def test_matched_pools_refuse(spark):
    catalog = spark.range(15).select(F.col("id").alias("item_id"))
    examples = spark.createDataFrame([(1, "user-1", [1], 2, "test")], "user_id long, session_id string, prefix array<long>, target long, split string")
    with pytest.raises(Exception, match="not enough eligible negatives"):
        pools.popularity_matched_pools(examples, catalog.withColumn("n", F.lit(1).cast("long")), catalog).collect()


def test_quantiles(spark):
    from sessionforge.operators.popularity import quantiles

    df = spark.range(10).select(F.col("id").alias("x"))
    assert quantiles(df, "x", 1 / 3, 2 / 3) == [3.0, 6.0] and quantiles(df.limit(0), "x", 0.5) == [None]


def test_hashed_tests(spark):
    rows = spark.createDataFrame([("c", f"s{i}", 1.0 + i % 3, 1.0) for i in range(30)] + [("z", f"s{i}", 1.0, 1.0) for i in range(5)], "comparison string, session_id string, a double, b double")
    got = {r["comparison"]: r for r in st.paired_tests(rows, n_flips=2_000, n_boot=500).collect()}
    c, z = got["c"], got["z"]
    assert c["n"] == 30 and c["mean"] == 1.0 and 0.6 < c["low"] < 1.0 < c["high"] < 1.4 and c["p_flip"] < 0.01 and c["p_wilcoxon"] < 0.001
    assert z["p_flip"] == 1.0 and z["statistic"] is None and z["p_wilcoxon"] is None
    base = np.arange(2_000) * 104_729 + 17
    times = np.searchsorted(np.array(st.POISSON), st.draws(base, st.RESAMPLES_FROM, 50), "right")
    assert abs(times.mean() - 1) < 0.03 and abs(times.var() - 1) < 0.05 and abs((st.draws(base, 0, 50) % 2).mean() - 0.5) < 0.02


def test_kendall(spark):
    rows = [("s", "a", i, float(i)) for i in range(6)] + [("s", "b", i, float(-i)) for i in range(6)] + [("s", "c", i, float(i // 2)) for i in range(6)] + [("t", m, i, 1.0) for m in "ab" for i in range(3)]
    got = {(r["session_id"], r["a"], r["b"]): r["tau"] for r in ensemble.kendall(spark.createDataFrame(rows, "session_id string, member string, item_id int, v double"), "v").collect()}
    assert got[("s", "a", "b")] == -1.0 and got[("t", "a", "b")] == 0.0
    assert got[("s", "a", "c")] == pytest.approx(12 / (15 * 12) ** 0.5, abs=1e-9)


def test_models_must_match(spark):
    from sessionforge.operators import records

    schema = "session_id string, model string, target long, length int, attempted int, broken int, single int, reliability_weighted int, mean_tau double, failure_reason string"
    left = spark.createDataFrame([("a", "m", 1, 5, 4, 0, 1, 2, 0.5, None), ("b", "m", 2, 5, 4, 1, 3, 1, 0.1, None), ("c", "m", 3, 5, 4, 3, None, None, None, "few")], schema)
    right = spark.createDataFrame([("a", "n", 1, 5, 4, 0, 2, 2, 0.4, None), ("b", "n", 2, 5, 4, 0, 1, 1, 0.2, None), ("d", "n", 4, 5, 4, 0, 1, 1, 0.9, None)], schema)
    got = records.alignment(records.matched(left, right)).first().asDict()
    assert got == {"left_trials": 3, "right_trials": 3, "matched": 2, "only_left": 1, "only_right": 1, "analysis": 2, "complete": 1}
    with pytest.raises(Exception, match="different data"):
        records.matched(left, right.withColumn("target", F.lit(9).cast("long"))).collect()
    with pytest.raises(ValueError, match="one model"):
        records.matched(left.union(right.where("session_id = 'd'")), right)
    with pytest.raises(ValueError, match="two records"):
        records.matched(left.union(left), right)


def test_prompts_refuse(spark):
    from sessionforge.operators import prompts

    items = spark.createDataFrame([(1, "One", ["g"]), (2, "Two", ["g"])], "item_id long, title string, genres array<string>")
    ask = lambda prefix, candidates: spark.createDataFrame([("s", 1, prefix, candidates)], "session_id string, user_id long, prefix array<long>, candidates array<long>")
    text = prompts.prompts(ask([1], [2]), items, ["next_step_v2"], "context_genre_v1", "game").first()
    assert "1. title=One; genres=g" in text["user_message"] and "exactly 1 candidates" in text["user_message"] and "last few games" in text["user_message"]
    for bad, why in ((ask([], [1]), "no history"), (ask([1], []), "no candidates"), (ask([1], [2, 2]), "candidates repeat"), (ask([1], [3]), "no title")):
        with pytest.raises(Exception, match=why):
            prompts.prompts(bad, items, ["next_step_v2"]).collect()
    with pytest.raises(ValueError):
        prompts.prompts(ask([1], [2]), items, ["unknown"])
    with pytest.raises(ValueError):
        prompts.prompts(ask([1], [2]), items, ["next_step_v2"], "context_crowd_v2")


def test_resumed_log(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([("a", "m", 1), ("b", "m", 2)], "trial_id string, model string, v int")
    assert tables.append_trials(first, path).count() == 2
    again = spark.createDataFrame([("b", "m", 2), ("c", "m", 3)], "trial_id string, model string, v int")
    tables.append_trials(again, path)
    assert sorted(r["trial_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="another model"):
        tables.append_trials(again.withColumn("model", F.lit("n")), path)
