"""Cases that the operators of the first round got wrong, each against its stated result."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionforge.llm import common, language_id, mixing, queries, token_files
from sessionforge.llm.decontaminate import contaminated
from sessionforge.llm.ngram_join import ngram_components
from sessionforge.llm.repeated_bytes import without_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n: int) -> str:
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


@pytest.mark.parametrize("n", [64, 128, 256, 1024, 2048])
def test_words_of_opposite_letters_differ(n):
    a = thue_morse(n)
    h, at = common.word_hashes(*common.text_buffer(pa.array([a, a.translate(str.maketrans("ab", "ba")), a.upper()])), common.byte_table())
    assert at.tolist() == [0, 1, 2, 3] and h[0] != h[1] and h[0] == h[2]


def test_word_hashes_against_words():
    texts = ["", None, " one\ttwo  ONE ", "x" * 255 + " " + "x" * 256 + " " + "x" * 257, "abcdefgh abcdefghi", "no space at the end", "begin"]
    h, at = common.word_hashes(*common.text_buffer(pa.array(texts)), common.byte_table())
    words = [w for t in texts for w in (t or "").lower().split()]
    assert np.diff(at).tolist() == [len((t or "").split()) for t in texts]
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_join_of_opposite_letters(spark):
    a = thue_morse(2048)
    rows = spark.createDataFrame([(1, a), (2, a.translate(str.maketrans("ab", "ba"))), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(rows, k=3, similarity=Fraction(9, 10)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_files_keep_every_id(spark):
    rows = spark.createDataFrame([(-5, "a b"), (-1, "c"), (None, "d e"), (None, None), (0, "f"), ((1 << 63) - 1, "g"), (-(1 << 63), "h")], "doc_id long, text string")
    got = token_files.token_files(rows, queries.vocabulary("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, -(1 << 63), -5, -1, 0, (1 << 63) - 1]


def test_bytes_of_rows_without_ids(spark):
    text = "a passage that is a good deal longer than fifty bytes, so that it counts as repeated. "
    rows = [(None, text + f"row {i} " * 12) for i in range(6)] + [(3, text + "the third"), (1, text + "the first"), ((1 << 63) - 1, "x" + text)]
    got = {}
    for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert got[1] == [0] and got[3][0] >= len(text) and len(got[None]) == 6 and all(n >= len(text) for n in got[None])
    assert got[(1 << 63) - 1][0] >= len(text) - 1


def test_mix_without_weight(spark):
    rows = [(i, "word " * 10, "en" if i % 2 else "de", f"src{i % 3 * 7}", 50) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs, fraction=0.5, epochs=2, domain_weights={"web": 0.0, "books": 1.0, "code": 1.0}).groupBy("domain").agg(F.sum("taken_tokens").alias("n")).collect()
    by = {r["domain"]: r["n"] for r in got}  # half of 600 tokens; a leaf's share is rounded down
    assert set(by) == {"books", "code"} and all(148 <= n <= 150 for n in by.values())
    assert mixing.mixed(docs, domain_weights={"web": 0.0, "books": 0.0, "code": 0.0}).collect() == []
    langs = mixing.mixed(docs, fraction=0.25, epochs=1, lang_weights={"en": 0.0, "de": 1.0}).select("lang").distinct().collect()
    assert [r["lang"] for r in langs] == ["de"]
    with pytest.raises(ValueError):
        mixing.mixed(docs, domain_weights={"web": -1.0})


def test_epochs_have_their_own_orders(spark):
    docs = spark.createDataFrame([(i, "w " * 4, "en", "src1", 8) for i in range(40)], DOCS)
    taken = [{r["doc_id"] for r in mixing.mixed(docs, fraction=f, epochs=2).where("prefix_tokens > 0").collect()} for f in (0.5, 1.5)]
    assert len(taken[0]) == len(taken[1]) == 20 and taken[0] != taken[1]


def test_prefix_keeps_white_space(spark):
    df = spark.createDataFrame([(" one\n\ttwo  three\nfour ", 3), ("a", 1), ("", 2)], "t string, n int")
    assert [r[0] for r in df.select(mixing.prefix_of(F.col("t"), F.col("n"))).collect()] == [" one\n\ttwo  three", "a", ""]


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j) % 97}" for j in range(300)) + (" the very short test item" if i % 2 else "")) for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the very short test item"), (2, "a very short test item")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in contaminated(docs, items).collect()) == list(range(1, 200, 2))


def test_many_languages(spark):
    words = [f"{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676 % 26)}" for i in range(520)]
    rows = [(4 * i + k, (words[i] + "xyz ") * 30, f"l{i}") for i in range(520) for k in range(4)]
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "lang_pred").collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id'] // 4}" for r in got) > 0.9 * len(got)


def plain_words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]


def test_stages_against_plain_python(spark, tmp_path):
    """Duplicates, decontamination and the mix of a small corpus, each stage against a version without any index."""
    base = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen",
            "ships and harbours lie quiet in the winter fog while gulls cry over the cold grey water of the bay"]
    rows = []
    for i in range(60):
        text = f"{base[i % 3]} {' '.join(f'x{i // 6}y{j}' for j in range(12))}"
        rows.append((i, text if i % 6 < 3 else text + (" extra" if i % 2 else ""), "en" if i % 4 else "de", f"src{i % 9}", len(text)))
    rows += [(100, None, "en", "src1", 0), (101, "", None, None, 0), (102, "held item words that the benchmark has in it as well", "en", "src2", 10)]
    docs = spark.createDataFrame(rows, DOCS)

    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := plain_words(r[1])) else set() for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = sorted(i for i in sets if find(i) == i)
    got = corpus_pipeline.duplicate_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == kept

    items = [(1, "held item words that the benchmark has in it"), (2, "ships and harbours lie quiet in the winter fog while gulls cry"), (3, "nothing like this anywhere at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shingles = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := plain_words(t)) else set()
    clean = sorted(r[0] for r in rows if not any(5 * len(s & sets[r[0]]) >= 4 * len(s) for s in (shingles(t) for _, t in items)))
    got = corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == clean and 0 < len(clean) < len(rows)

    mixed = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    source = {r[0]: plain_words(r[1]) for r in rows}
    taken = {r["doc_id"]: plain_words(r["text"]) for r in mixed}
    assert all(words and words == source[i][: len(words)] for i, words in taken.items())
    total = sum(map(len, source.values()))
    assert abs(sum(map(len, taken.values())) - total // 2) <= len({(r[2], r[3]) for r in rows})
    by = mixing.mixed(docs, epochs=1).collect()
    assert {r["doc_id"]: r["taken_tokens"] for r in by} == {i: len(w) for i, w in taken.items()}
