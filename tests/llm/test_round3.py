"""Large groups and tables beyond a broadcast in the n-gram join."""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import functions as F

from sessionforge.llm import ngram_join as ng
from sessionforge.llm import repeated_bytes as rb


def _near_copies(spark, n: int):
    """n near copies of one text, each with a word of its own, and n texts of other words."""
    draw = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in draw.sample(range(0, 120, 6), 1):
            words[at] = f"x{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(f"y{i}z{j}" for j in range(30)))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _components(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_rounds_offer_a_set_few_partners_however_large_its_group(spark):
    n = 1200
    shared = spark.range(n).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("key"), F.col("id").alias("name"), F.lit(50).alias("size"), F.lit(True).alias("probe"))
    sets = ng.saved(spark.range(n).select(F.col("id").alias("name"), F.lit(bytes(16)).alias("sketch")))
    links = spark.createDataFrame([], "u long, v long")
    met = ng._open_keys(ng.saved(shared), links)
    assert met.select("blocks").distinct().first()[0] == 3
    pairs = ng._open_pairs(met, sets, Fraction(4, 5), nearest_only=True, turn=0)
    emitted = [r for r in pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").count().collect()]
    assert len(emitted) == n and pairs.count() <= ng.FIRST_KEYS * n


def test_keys_of_one_component_are_dropped(spark):
    shared = ng.saved(spark.createDataFrame([(1, 10, 5, True), (1, 11, 5, True), (2, 10, 5, True), (2, 12, 5, True)], "key long, name long, size int, probe boolean"))
    left = ng._open_keys(shared, spark.createDataFrame([(10, 11)], "u long, v long"))
    assert {r["key"] for r in left.collect()} == {2}


def test_shares_and_passes_leave_the_components_as_they_are(spark, monkeypatch):
    docs = _near_copies(spark, 20).union(spark.createDataFrame([(None, "w1 w2 w3 w4 w5 w6 w7"), (3, "w1 w2 w3 w4 w5 w6 w7")], "doc_id long, text string"))
    whole = _components(ng.ngram_components(docs))
    monkeypatch.setattr(ng, "BROADCAST_IDS", 12)
    monkeypatch.setattr(ng, "PAIRS_AT_ONCE", 5)
    plans = []
    monkeypatch.setattr(ng, "saved", lambda df, saved=ng.saved: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), saved(df))[1])
    assert _components(ng.ngram_components(docs)) == whole
    assert len({c for i, _, c in whole if i is not None and i % 2 == 0}) == 1
    assert any(p.count("LeftSemi") > 1 and "MapInArrow" in p for p in plans)  # several passes over the texts, no deal of them


def test_hashes_of_anchors_are_gone_before_contexts_travel(spark, monkeypatch):
    text = "a passage of more than fifty bytes that two of these documents have in common"
    docs = spark.createDataFrame([(1, f"first one, with {text}, and more"), (2, f"second: {text}!"), (3, "else")], "doc_id long, text string")
    steps = []
    monkeypatch.setattr(rb, "saved", lambda df, saved=rb.saved: (steps.append(df.columns), saved(df))[1])
    monkeypatch.setattr(rb, "cleaned", lambda session: steps.append("cleaned"), raising=False)
    out = rb.without_repeats(docs)
    assert steps[-2:] == [["row", "gram"], "cleaned"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # contexts, ranges, what is kept
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: len(text) + 1, 3: 0}  # with the blank before it
