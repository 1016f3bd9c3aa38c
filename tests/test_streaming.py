from __future__ import annotations

import json

from sessionforge.streaming import trials


def test_log_is_written_once(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    row = lambda i, rank: json.dumps({"trial_id": f"t{i}", "session_id": f"s{i}", "member": "a", "model": "m", "parse_success": True, "target_rank": rank, "finished": "2026-01-01T00:00:00Z"})
    (source / "1.json").write_text(row(1, 1) + "\n" + row(2, 2) + "\n" + '{"trial_id": "cut')
    trials.logged(trials.trials(spark, str(source)), str(out), str(state)).awaitTermination()
    (source / "2.json").write_text(row(2, 2) + "\n" + row(3, 4) + "\n")
    trials.logged(trials.trials(spark, str(source)), str(out), str(state)).awaitTermination()
    assert sorted(r["trial_id"] for r in spark.read.parquet(str(out)).collect()) == ["t1", "t2", "t3"]


def test_hourly(spark, tmp_path):
    rows = [("t1", "s", "a", "m", True, 1), ("t2", "s", "a", "m", True, 2), ("t3", "s", "a", "m", False, None)]
    df = spark.createDataFrame(rows, "trial_id string, session_id string, member string, model string, parse_success boolean, target_rank int").selectExpr("*", "timestamp'2026-01-01 00:10:00' AS finished")
    got = trials.hourly(df).first()
    assert (got["trials"], got["failed"], got["mrr"]) == (3, 1, 0.75)
