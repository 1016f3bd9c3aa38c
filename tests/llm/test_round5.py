"""Disk of the suffix-array dedup: texts travel once, and the hashes of all anchors go before contexts travel."""

from __future__ import annotations

import re

from sessionforge.llm import common
from sessionforge.llm.repeated_bytes import without_repeats


def _docs(spark):
    same = "a passage of rather more than fifty bytes that stands in several documents "
    return spark.createDataFrame([(i, f"{i} {same}{i * 7} and what only number {i} says, as it were") for i in range(20)], "doc_id long, text string")


def test_texts_travel_once(spark):
    """Both joins by row read the same columns, so that the second one reuses the first one's shuffle."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = without_repeats(_docs(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    dealt = re.findall(r"(?<!, )Exchange hashpartitioning\(row#", plan)
    assert len(dealt) == 3  # texts, their shared grams, their ranges
    assert re.search(r"ReusedExchange \[id#\w+, text#\w+, row#\w+\]", plan)


def test_shuffles_of_ended_jobs_go(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held() -> set[str]:
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    before = held()
    common.saved(spark.range(1000).repartition(3).selectExpr("id % 7 AS k").groupBy("k").count())
    common.cleaned(spark, 3)
    assert not held() - before
