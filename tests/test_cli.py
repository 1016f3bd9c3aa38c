"""The commands from raw files to reports, on a small corpus of ratings."""

from __future__ import annotations

import json

import pytest

from sessionforge import cli
from sessionforge.sources import domains, tables


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    (top / "raw/ml-1m").mkdir(parents=True)
    rows = tables.interactions(spark, "/root/testdata/sf0.001").where("user_id < 60").select("user_id", "item_id", "rating", "timestamp").collect()
    (top / "raw/ml-1m/ratings.dat").write_text("".join(f"{r['user_id']}::{r['item_id']}::{int(r['rating'])}::{r['timestamp']}\n" for r in rows))
    items = tables.items(spark, "/root/testdata/sf0.001").collect()
    (top / "raw/ml-1m/movies.dat").write_text("".join(f"{r['item_id']}::{r['title']} (19{r['item_id'] % 90 + 10})::{'|'.join(r['genres'])}\n" for r in items), encoding="latin-1")
    return top


def call(name, **options):
    cli.main([name, *[x for k, v in options.items() for x in (f"--{k.replace('_', '-')}", str(v))]])


def test_from_ratings_to_reports(spark, data):
    raw, out, results = data / "raw", data / "processed", data / "results"
    call("prepare-movielens", root=raw, out=out)
    call("build-benchmark", domain="movielens", root=raw, out=out)
    call("build-item-popularity", domain="movielens", root=raw, output=data / "popularity")
    splits = {r["split"]: r["n"] for r in json.loads((out / "ml1m_splits.json").read_text())}
    assert set(splits) == {"validation", "test"}
    pool = spark.read.json(str(out / "ml1m_pool_popularity_matched.jsonl"))
    assert pool.count() == sum(splits.values()) and pool.where("size(candidate_item_ids) <> 20 OR candidate_item_ids[target_position] <> target").isEmpty()
    call("run-ensemble", domain="movielens", root=raw, processed=out, out=data / "run")
    call("run-ensemble", domain="movielens", root=raw, processed=out, out=data / "run")  # resumes: nothing is left to do
    answers = spark.read.parquet(str(data / "run/answers"))
    assert answers.count() == sum(splits.values()) * 4 * 20
    call("evaluate-ensemble", trials=data / "run", processed=out, prefix="ml1m", out=results, popularity_file=data / "popularity")
    got = {r["condition"]: r for r in json.loads((results / "conditions.json").read_text())}
    assert len(got) == 6 and all(r["valid"] == sum(splits.values()) for r in got.values())
    call("power-analysis", trials=data / "run", processed=out, prefix="ml1m", out=results)
    call("evaluate-baseline", trials=data / "run", prefix="ml1m", out=results)
    call("compare-variants", metrics=f"stub={results / 'baseline.json'}", out=results)
    assert len(json.loads((results / "best_variants.json").read_text())) == 5
    call("summarize", trials=data / "run", out=results)
    assert json.loads((results / "summary.json").read_text())["longest_prompt"] > 500


def test_names():
    assert domains.slug("Qwen2.5:7B-x") == "qwen2_5_7b_x"
    assert domains.parsed_inputs(["a=b/c"]) == {"a": "b/c"}
    assert domains.movie_files("tv") == ("tv_ratings_subset.csv", "tv_items_subset.jsonl")
    with pytest.raises(ValueError):
        domains.parsed_members(["x"], ["x"], ["y"])
    with pytest.raises(ValueError):
        domains.movie_files("radio")
    with pytest.raises(FileNotFoundError):
        domains.found("/nowhere", "x", "y.csv")


def test_subset_of_music(spark, tmp_path):
    lines = [f"u{u},A{i},5.0,{1_000_000_000_000 + 100_000_000 * i + u}" for u in range(8) for i in range(6)] + ["u1,B9,4.0,5"]
    (tmp_path / "ratings.csv").write_text("user_id,parent_asin,rating,timestamp\n" + "\n".join(lines) + "\n")
    meta = [{"parent_asin": f"A{i}", "title": f"Record {i}", "categories": ["CDs & Vinyl", "Jazz", "Bebop"], "store": "Some Trio (Artist)  Format: Vinyl", "price": "9.5", "details": {}} for i in range(6)] + [{"parent_asin": "C1", "title": "not rated"}]
    (tmp_path / "meta.jsonl").write_text("\n".join(map(json.dumps, meta)) + "\n")
    got = domains.build_subset(spark, "amazon_music", str(tmp_path / "ratings.csv"), str(tmp_path / "meta.jsonl"), str(tmp_path / "out"), share=1.0).first()
    assert (got["ratings"], got["users"], got["items"], got["items_with_genre"], got["over_a_day"]) == (48, 8, 6, 6, 1.0)
    raw = tables.read_raw_ratings(spark, str(tmp_path / "out/music_ratings_subset.csv"))
    assert raw.count() == 48
    _, _, things = domains.dense_ratings(raw)
    items = domains.domain_items(spark, str(tmp_path / "out/music_items_subset.jsonl"), things).orderBy("item_id").collect()
    assert [tuple(r) for r in items][:1] == [(1, "Record 0 by Some Trio", "Jazz", "Bebop", "", "Vinyl", 9.5)]
