"""The training-data operators against brute force, exact round trips, held-out accuracy and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionforge.llm import common, language_id, licenses, mixing, nearest, queries, repeated_bytes, suffix_array, token_counts, token_files, toxicity
from sessionforge.llm.components import components
from sessionforge.llm.ngram_join import allocation, bands, ngram_components

from ..oracle import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_components(rows, k, similarity):
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    sets, inverse = {}, defaultdict(list)
    for i, t in rows:
        w = words.findall((t or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        for s in sets[i]:
            inverse[s].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverse[x] if j < i).items():
            if Fraction(n, len(s | sets[j])) >= similarity:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(seed, n=60):
    """Texts in families of edits of edits, so that many pairs are near the threshold on either side."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n // 10):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 30, 80, 200]))]
        for _ in range(10):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(max(1, len(base) // 40)):
                base[rng.randrange(len(base))] = rng.choice(words)
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "similarity"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(4, 5))])
def test_join_on_families(spark, k, similarity):
    rows = families(k)
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, similarity=similarity).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k, similarity)


def test_join_on_documents(spark, docs):
    same(queries.op2(spark, SF), SF, queries.ORACLE_SQL["op2_ngram_join"])


def test_allocation_uses_both_ways():
    low = bands(Fraction(9, 10), 20_000)
    plan = allocation(low, Fraction(9, 10), 10**6)
    assert any(p[2] for p in plan) and any(not p[2] for p in plan)
    assert all(2 * m > h if one else m > h for h, m, one in plan)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 160)}


def brute_repeats(rows):
    seen, out = set(), {}
    for i, group in sorted((i, [t for j, t in rows if j == i]) for i in {j for j, _ in rows}):
        mine = set()
        for t in group:
            b = (t or "").encode()
            gone = bytearray(len(b))
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                mine.add(w)
                if w in seen:
                    gone[p : p + 50] = b"\1" * 50
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            out.setdefault(i, []).append((len(b), len(b) - len(kept), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
        seen |= mine
    return {i: sorted(v) for i, v in out.items()}


def test_repeats(spark):
    rng = random.Random(3)
    passage = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 140))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passage)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 4))] + ["".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))]
        rng.shuffle(parts)
        rows.append((i, "".join(parts)))
    rows += [(61, "a" * 300), (62, "a" * 120), (63, None), (64, ""), (65, "x" * 49), (66, "x" * 49), (70, rows[0][1]), (70, rows[1][1]), (71, rows[5][1] * 2)]
    got = defaultdict(list)
    for r in repeated_bytes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert {i: sorted(v) for i, v in got.items()} == brute_repeats(rows)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(300):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60))
        order = suffix_array.suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:].tolist())
        s = t.tolist()
        want = [s[a : a + 3] == s[b : b + 3] and max(a, b) + 3 <= len(s) for a, b in zip(order[:-1], order[1:], strict=True)] + [False]
        assert suffix_array.repeats(t, order, 3).tolist() == want


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.vocabulary("piece_bpe_32k.model")
    t = Tokenizer(models.Unigram(token_counts.load_pieces(path), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    odd = [(-1, None), (-2, ""), (-3, "  a  b "), (-4, "日本 語▁x \n\t🙂"), (-5, "x" * 3000), (-5, "x" * 3000)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = rows.collect()
    got = sorted(tuple(r) for r in token_counts.token_counts(rows, path).select("doc_id", "n_tokens").collect())
    assert got == sorted((i, len(t.encode(x or "").ids)) for i, x in texts)
    small = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -9.0), ("▁", -0.5)]
    own = token_counts.UnigramCounter(small, byte_fallback=False)
    ref = Tokenizer(models.Unigram([("<unk>", 0.0), *small], unk_id=0, byte_fallback=False))
    for word in ("ab", "aab", "abcab", "czz", "azzb", "zz"):
        assert own.word(word)[0] == len(ref.encode(word).ids), word


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    odd = [(1000, None), (1001, ""), (1002, "a  b \n c"), (1003, "x<|endoftext|>y"), (1004, "it's 12, ok... don't stop"), (1005, "a\x00b c"), (1006, " lead and trail "), (1006, "again")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    want, start = [], 0
    for i, x in sorted(rows.collect(), key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.token_files(rows, queries.vocabulary("byte_bpe_50k.json")).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == want


def test_language_id(spark):
    rows = queries.op6(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert rows.where("score < 0 OR score > 1").isEmpty()


def test_cross_parsing_by_hand():
    texts = {"x": b"abracadabra", "y": b"xyzzyx"}
    p = language_id.CrossParser(texts)
    for text in (b"abrabra", b"cadxyz", b"zzz", b"q", b"aqb"):
        counts, _ = p.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        for j, name in enumerate(p.names):
            n, at = 0, 0
            while at < len(text):
                size = 1
                while at + size < len(text) and text[at : at + size + 1] in texts[name]:
                    size += 1
                n, at = n + 1, at + size
            assert abs(int(counts[0, j]) - n) <= 1, (text, name)


def test_nearest(spark):
    got = queries.op7(spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hits = 0
    for q, g in got.groupby("query_id"):
        i = int(np.searchsorted(ids, q))
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 21)) or sorted(g["rank"]) == list(range(1, 21))
        assert np.allclose(g.score, s[np.searchsorted(ids, g.vec_id)], rtol=0, atol=1e-12)
    assert hits / len(got) >= 0.9


def test_nearest_few_and_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0)]


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    # 0.917 and 0.0008 were measured. 9 of the 12 misses hold no marker at all and score as a text without evidence does.
    rows = queries.op10(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, nothing = rows[rows.toxic == 1], rows.score.min()
    assert toxic.predicted.mean() > 0.9 and rows[rows.toxic == 0].predicted.mean() < 0.005
    assert toxic[toxic.score > nothing + 0.01].predicted.mean() > 0.95
    hit = rows[(rows.toxic == 1) & (rows.predicted == 1)]
    assert (hit.spans.map(len) > 0).mean() > 0.95


def test_toxicity_in_each_language(spark):
    """Rare languages' toxic stems also stand in long clean documents now and then, so presence alone hides them."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op10(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    recall, alarms = rows[rows.toxic == 1].groupby("lang").predicted.mean(), rows[rows.toxic == 0].groupby("lang").predicted.mean()
    assert recall.min() >= 0.85 and alarms.max() <= 0.01, (recall.to_dict(), alarms.to_dict(), rows.groupby("toxic").predicted.mean().to_dict())


def test_markers_go_by_frequency():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) + " vile vile vile vile" for _ in range(40)] + [" ".join(rng.choice(words, 2_000)) + " vile" * int(i % 3 == 0) for i in range(120)]
    raw, at = common.text_buffer(toxicity.pa.array(texts, toxicity.pa.large_string()))
    h, bounds, _, _ = toxicity.features(raw, at)
    own, _, _, _ = toxicity.features(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))
    found = toxicity.markers(h, bounds, np.arange(160) < 40)
    assert len(found) and set(found) <= set(own[0])


def test_marginals_by_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    t, s, e = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=7)
    begins = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    want = np.zeros(7)
    total = 0.0
    for y in itertools.product((0, 1), repeat=7):
        w = np.exp(sum((s[y[i]] if begins[i] else t[y[i - 1], y[i]]) + y[i] * e[i] for i in range(7)))
        total += w
        want += w * np.array(y)
    assert np.allclose(toxicity.marginals(e, begins, t, s), want / total)
    long = rng.normal(size=40_000)
    begins = rng.random(40_000) < 0.01
    begins[0] = True
    strips = toxicity.marginals(long, begins, t, s)
    a, b = np.flatnonzero(begins)[[3, 4]]
    assert np.allclose(strips[a:b], toxicity.marginals(long[a:b], begins[a:b], t, s))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), SF, queries.ORACLE_SQL[name])


def test_license_notices(spark):
    texts = [(i, f"before {i} " * 9 + t + " and after " * 9) for i, t in enumerate(licenses.TEMPLATES.values())]
    got = licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string"))
    best = {(r["doc_id"], r["license"]) for r in got.where("containment = 1").collect()}
    assert {(i, n) for i, n in enumerate(licenses.TEMPLATES)} <= best


def test_sibling_licenses(spark):
    """Each notice, within other words, is its own license and no sibling's; an unknown version is none."""
    known = licenses.TEMPLATES | licenses.SIBLINGS

    def spdx(name):
        return re.sub("-(notice|line)$", "", name)

    names = [n for n in known if n != "BSD-3-Clause-notice"]  # the opening that BSD-2 has too
    texts = [(i, f"before {i} " * 9 + known[n] + " and after " * 9) for i, n in enumerate(names)]
    texts += [(100, "x y z. This work is licensed under the GNU General Public License, version 1."), (101, f"{known['GPL-2.0']} Or: {known['GPL-3.0']}"), (102, known["MIT"] + " " + known["Apache-2.0"])]
    texts += [(103, known["GPL-2.0"]), (103, "a b c d e f g " * 20 + known["MIT"])]
    got = defaultdict(set)
    for r in licenses.licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got[r["doc_id"]].add(spdx(r["license"]))
    assert {i: got[i] for i in range(len(names))} == {i: {spdx(n)} for i, n in enumerate(names)}
    assert [got[i] for i in range(100, 104)] == [set(), {"GPL-2.0", "GPL-3.0"}, {"MIT", "Apache-2.0"}, {"GPL-2.0", "MIT"}]


def test_mix_shares_shortages(spark):
    rows = [(i, "w " * 10, "en", "src1", 20) for i in range(2)] + [(10 + i, "w " * 10, "en", "src2", 20) for i in range(50)] + [(100 + i, "w " * 10, "de", "src8", 20) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(docs, fraction=0.5, epochs=1, domain_weights={"web": 0.5, "books": 0.5}, lang_weights={"en": 1.0, "de": 1.0}).groupBy("source").agg(F.sum("taken_tokens").alias("n")).collect()
    # 510 of 1020 tokens: 255 a domain; src1 has only 20 of its 127, its sibling src2 gives the rest
    assert {r["source"]: r["n"] for r in got} == {"src1": 20, "src2": 235, "src8": 255}


def test_held_out_rule(spark):
    got = spark.range(200).select("id", common.held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
