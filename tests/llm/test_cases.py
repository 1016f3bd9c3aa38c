"""Each operator and each pipeline stage on empty tables, nulls, empty, wordless and long texts, repeats, and extra
columns with names that the operators use themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionforge.llm import queries
from sessionforge.llm.decontaminate import contaminated, decontaminated
from sessionforge.llm.language_id import language_id
from sessionforge.llm.licenses import licenses
from sessionforge.llm.mixing import mixed
from sessionforge.llm.ngram_join import ngram_components
from sessionforge.llm.repeated_bytes import without_repeats
from sessionforge.llm.token_counts import token_counts
from sessionforge.llm.token_files import token_files
from sessionforge.llm.toxicity import toxicity

EN = "the cat sat on the mat and looked at the other cat in the house near the sea. " * 3
DE = "der hund lief durch den wald und sah die katze auf dem dach neben dem haus am see. " * 3
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("name", "key", "doc", "gram", "size", "h", "part", "label", "n", "tokens", "u", "held_out", "score", "item_id", "order__")
ROWS = [
    (1, EN, "en", "src1", 1), (2, EN, "en", "src1", 1), (3, DE, "de", "src8", 1), (4, None, "en", None, None), (5, "", None, "src1", 0),
    (6, "   \n\t ", "de", "x", 5), (7, "4242 !!! ...", "en", "src9", 9), (8, "word " * 30_000, "en", "src2", 150_000), (9, "x" * 100_000, None, "src2", 100_000),
    (None, EN + " and more", "en", "src1", 1), (None, None, None, None, None), (10, DE + EN, "fr", "src3", 1), (10, DE + EN, "fr", "src3", 1), (11, "two words", "en", "src1", 9),
]
ITEMS = [(1, "looked at the other cat in the house near the sea"), (2, None), (3, ""), (4, "two words"), (4, "two words"), (None, DE)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_join(docs, empty):
    got = sorted((tuple(r) for r in ngram_components(docs, k=3).collect()), key=repr)
    by = {}
    for i, n, c in got:
        by.setdefault(i, []).append((n, c))
    assert by[1][0][1] == by[2][0][1] == 1 and by[2][0][0] == by[1][0][0]
    assert by[4] == [(0, 4)] and by[5] == [(0, 5)] and by[6] == [(0, 6)] and by[7][0] == (1, 7) and by[8] == [(1, 8)]
    assert len(by[10]) == 2 and len(got) == len(ROWS)
    assert (0, None) in by[None] and any(c == 1 for _, c in by[None])
    assert ngram_components(empty).collect() == []


def test_bytes(docs, empty):
    got = {}
    for r in without_repeats(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[2][0]["n_removed"] == got[2][0]["n_bytes"] > 0 and got[1][0]["n_removed"] == 0
    assert got[4][0]["n_bytes"] == 0 and len(got[10]) == 2 and len(got[None]) == 2
    assert sum(map(len, got.values())) == len(ROWS)
    assert without_repeats(empty).collect() == []


def test_counts(docs, empty):
    got = token_counts(docs, queries.vocabulary("piece_bpe_32k.model")).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (4, 5)} == {0}
    assert token_counts(empty, queries.vocabulary("piece_bpe_32k.model")).collect() == []


def test_files(docs, empty):
    got = token_files(docs, queries.vocabulary("byte_bpe_50k.json")).orderBy("start").collect()
    assert len(got) == len(ROWS) and [r["doc_id"] for r in got[:2]] == [None, None]
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5)} == {1}
    assert token_files(empty, queries.vocabulary("byte_bpe_50k.json")).collect() == []


def test_language(docs, empty, spark):
    got = language_id(docs).collect()
    assert len(got) == len(ROWS)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (4, 5, 6, 7)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    assert language_id(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None, None, 1)], DOCS)
    assert [r["lang_pred"] for r in language_id(unlabelled).collect()] == ["und"]


def test_licenses(docs, empty):
    assert licenses(docs).collect() == [] and licenses(empty).collect() == []
    twice = docs.select("doc_id", F.lit("It is Released under the MIT License.").alias("text"))
    assert {r["license"] for r in licenses(twice).collect()} == {"MIT"}


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert {(1, 1), (2, 1), (10, 1), (None, 1), (11, 4), (3, None), (10, None)} == got
    assert {r["doc_id"] for r in decontaminated(docs, items).collect()} == {4, 5, 6, 7, 8, 9, None}
    assert contaminated(empty, items).collect() == [] and contaminated(docs, items.limit(0)).collect() == []


def test_mixing(docs, empty):
    got = mixed(docs, fraction=1.0, epochs=1).collect()
    assert all(0 < r["taken_tokens"] <= r["n_tokens"] for r in got) and {r["doc_id"] for r in got} <= {r[0] for r in ROWS}
    assert mixed(empty).collect() == []


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, 0), (None, 0, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity(empty, labels).collect() == [] and len(toxicity(docs, labels.limit(0)).collect()) == len(ROWS)


def test_stages(spark, docs, empty):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != "token files":
            assert out.columns == docs.columns
            assert out.schema.simpleString() == docs.schema.simpleString()
        none = stage(spark, empty, sf)
        assert none.collect() == []
        assert len(rows) <= len(ROWS)
        if name == "language ID":
            assert {r["doc_id"] for r in rows} == {1, 2, 3, 8, 9, 10, 11, None}
        if name == "n-gram Jaccard join":
            kept = [r["doc_id"] for r in rows]
            assert kept.count(10) == 1 and 2 not in kept and 1 in kept


def test_rows_with_null_and_repeated_ids(spark):
    other, third, near = "one two three four five six seven eight nine ten " * 2, "a quite different text about ships and harbours in winter", EN + "more"
    rows = [(1, EN), (None, near), (7, other), (7, third), (None, DE), (None, DE + "und"), (None, None), (None, None), (8, DE[:40]), (8, DE[:40])]
    df = spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in rows], DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.duplicate_stage(spark, df, "").collect()), key=repr)
    german = [r for r in kept if r in ((None, DE), (None, DE + "und"))]
    assert len(german) == 1
    assert kept == sorted([(1, EN), (7, other), (7, third), *german, (None, None), (None, None), (8, DE[:40])], key=repr)
    items = spark.createDataFrame([(1, "looked at the other cat in the house near the sea"), (2, third)], "item_id long, text string")
    clean = sorted(((r["doc_id"], r["text"]) for r in decontaminated(df, items).collect()), key=repr)
    assert clean == sorted([r for r in rows if r[1] not in (EN, near, third)], key=repr)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
