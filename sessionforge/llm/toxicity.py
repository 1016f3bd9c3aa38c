"""Toxicity: a linear-chain conditional random field over words tags toxic spans.

Labels are of documents, so words are labelled first: features (word, prefixes, suffixes) that are far more frequent
among the words of toxic documents than among those of clean ones are chosen greedily, each counting most where a
toxic document is still without one. Frequency is by word, as a long clean document holds many a stem by chance; a word of a toxic document that carries one is labelled toxic. The field learns from those words in their
windows; forward-backward gives each word's marginal, and a logistic function of a document's marginals and of their density
its score.

Everything is numpy over whole batches: features are hashes of byte ranges out of one prefix sum, and the chain is
run in strips side by side that are joined by their 2 x 2 transfer matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _powers, byte_table, held_out, mix, slices, text_buffer, tidy

ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789'"
#: Feature kinds, the most telling first: the word, then so many first (positive) or last (negative) bytes.
KINDS = (0, 6, 5, 4, 3, -5, -4, -3)
#: Labelled documents of each class that are learned from at most (about, by hash), by their whole texts, and bytes of
#: them whose features are made at once.
TRAIN_EACH_CLASS, TRAIN_PART = 2_000, 1 << 20
#: A marker occurs in this share of toxic documents at least, and this precise: among as many words of toxic as of
#: clean documents, this share of its occurrences is in toxic ones.
LEAST_SHARE, PRECISION, MARKERS = 0.004, 0.97, 512
WINDOW, WINDOWS, FEATURES, STEPS = 24, 4_000, 8_192, 120
STRIPS = 2_048
SPAN_AT = 0.5
PREDICT_AT = 0.7
ROWS = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word's features (words x kinds, 0 where it is too short), words' bounds by text, first and last byte."""
    low = byte_table(ALPHABET)[raw]
    n = len(low)
    if not n:
        return np.zeros((0, len(KINDS)), np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = low != 0
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:n]
    end[:-1] &= ~inside[1:] | fresh[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + U64(1)) * up[:n], out=sums[1:])
    size = last - first + 1
    out = np.zeros((len(first), len(KINDS)), np.uint64)
    for j, k in enumerate(KINDS):
        a = first if k >= 0 else np.maximum(last + 1 + k, first)
        b = last + 1 if k <= 0 else np.minimum(first + k, last + 1)
        h = mix((sums[b] - sums[a]) * down[a] + U64((j + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
        out[:, j] = np.where(size >= abs(k), h | U64(1), U64(0)) if k else h | U64(1)
    return out, np.searchsorted(first, at), first, last


class Lookup:
    """Places of known hashes: 1 and up, 0 for others. A bit table turns most away first."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.known >> U64(44)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(h.shape, np.int32)
        if len(self.known):
            maybe = self.bits[h >> U64(44)]
            some = h[maybe]
            at = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == some, at + 1, 0)
        return out


def marginals(emission: np.ndarray, begins: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(toxic) of each word. emission: log-potential of toxic against clean; begins: True at each text's first word;
    transition (2 x 2) and start (2): log-potentials."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    steps = -(-n // STRIPS) if n > STRIPS * 8 else n
    strips = -(-n // steps)
    total = steps * strips
    e = np.zeros(total)
    e[:n] = np.exp(np.clip(emission, -30, 30))
    e[n:] = 1
    b = np.ones(total, bool)
    b[:n] = begins
    e, b = e.reshape(strips, steps).T.copy(), b.reshape(strips, steps).T.copy()
    t, s = np.exp(transition), np.exp(start)
    a00, a10 = np.where(b, s[0], t[0, 0]), np.where(b, s[0], t[1, 0])
    a01, a11 = np.where(b, s[1], t[0, 1]) * e, np.where(b, s[1], t[1, 1]) * e

    p = [np.ones(strips), np.zeros(strips), np.zeros(strips), np.ones(strips)]  # product of a strip's matrices
    for i in range(steps):
        p = [p[0] * a00[i] + p[1] * a10[i], p[0] * a01[i] + p[1] * a11[i], p[2] * a00[i] + p[3] * a10[i], p[2] * a01[i] + p[3] * a11[i]]
        scale = 1 / (p[0] + p[1] + p[2] + p[3])
        p = [x * scale for x in p]
    m = np.array(p).T.reshape(strips, 2, 2)
    left, right = np.full((strips, 2), 0.5), np.full((strips, 2), 0.5)
    for i in range(1, strips):
        v = left[i - 1] @ m[i - 1]
        left[i] = v / v.sum()
        w = m[strips - i] @ right[strips - i]
        right[strips - 1 - i] = w / w.sum()
    f0, f1 = np.empty_like(e), np.empty_like(e)
    x, y = left[:, 0], left[:, 1]
    for i in range(steps):
        x, y = x * a00[i] + y * a10[i], x * a01[i] + y * a11[i]
        scale = 1 / (x + y)
        x, y = x * scale, y * scale
        f0[i], f1[i] = x, y
    x, y = right[:, 0], right[:, 1]
    for i in range(steps - 1, -1, -1):
        f0[i] *= x
        f1[i] *= y
        x, y = a00[i] * x + a01[i] * y, a10[i] * x + a11[i] * y
        scale = 1 / (x + y)
        x, y = x * scale, y * scale
    return (f1 / (f0 + f1)).T.reshape(-1)[:n]


def _evidence(m: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text: log of 1 + the expected number of toxic words among likely ones, the greatest marginal, and log
    of 1 + the expected number in a hundred words."""
    likely = np.concatenate([[0.0], np.cumsum(np.where(m > 0.05, m, 0.0))])
    out = np.zeros((len(bounds) - 1, 3))
    expected = np.maximum(likely[bounds[1:]] - likely[bounds[:-1]], 0)
    out[:, 0] = np.log1p(expected)
    out[:, 2] = np.log1p(100 * expected / np.maximum(np.diff(bounds), 1))
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full, 1] = np.maximum.reduceat(m, bounds[:-1][full])
    return out


class Model:
    """Features' weights, transitions and start of the field, and the weights of the document's score."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, transition: np.ndarray, start: np.ndarray):
        self.known, self.weights, self.transition, self.start = known, weights, transition, start
        self.document = np.zeros(4)
        self.find = Lookup(known)

    def tag(self, raw: np.ndarray, at: np.ndarray):
        h, bounds, first, last = features(raw, at)
        begins = np.zeros(len(h), bool)
        begins[bounds[:-1][bounds[:-1] < len(h)]] = True
        emission = np.full(len(h), self.weights[0])
        for j in range(len(KINDS)):
            emission += np.where((x := self.find(h[:, j])) > 0, self.weights[x], 0)
        return marginals(emission, begins, self.transition, self.start), bounds, first, last

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.document[:-1] + self.document[-1], -500, 500)))


def markers(h: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Hashes of the features that mark toxic documents, chosen greedily. Copies of a text share one vote. Whether a
    feature qualifies goes by its occurrences among all words of a class, what it is worth by the documents it is in."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    sketch = np.zeros(len(toxic), np.uint64)
    full = bounds[1:] > bounds[:-1]
    if len(h) > 1:
        pair = mix(h[:, 0] * U64(3) + np.roll(h[:, 0], 1))
        sketch[full] = np.minimum.reduceat(pair, bounds[:-1][full])
    _, group, size = np.unique(sketch, return_inverse=True, return_counts=True)
    vote = 1.0 / size[group]
    least = max(3.0, LEAST_SHARE * vote[toxic].sum())
    words = vote * np.diff(bounds)
    words_t, words_c = max(words[toxic].sum(), 1), max(words[~toxic].sum(), 1)
    names, kind, members = [], [], []
    for j in range(len(KINDS)):  # a feature's hash holds its kind, so kinds are counted one by one
        order = np.lexsort((doc, h[:, j]))
        keys, docs = h[order, j], doc[order]
        some = keys != 0
        keys, docs = keys[some], docs[some]
        if not len(keys):
            continue
        run = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
        often = np.diff(np.append(run, len(keys)))
        keys, docs = keys[run], docs[run]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.append(at[1:], len(keys))
        t = np.add.reduceat(vote[docs] * toxic[docs], at)
        found_t, found_c = np.add.reduceat(vote[docs] * often * toxic[docs], at), np.add.reduceat(vote[docs] * often * ~toxic[docs], at)
        rate_t, rate_c = found_t / words_t, found_c / words_c
        for g in np.flatnonzero((t >= least) & (rate_t >= PRECISION / (1 - PRECISION) * rate_c) & (rate_t > (found_c + 1) / words_c)):
            names.append(keys[at[g]])
            kind.append(j)
            members.append(docs[at[g] : ends[g]])
    names = np.array(names, np.uint64)
    gain = dict.fromkeys(range(len(names)), 0.0)
    worth = vote * toxic
    chosen: list[int] = []
    for _ in range(MARKERS):
        for g in gain:
            gain[g] = worth[members[g]].sum()
        best = max(gain, key=lambda g: (round(gain[g], 6), -kind[g], -int(names[g])), default=None)
        if best is None or gain[best] < least:
            break
        chosen.append(best)
        worth[members[best]] *= 0.5
        del gain[best]
        gain = {g: v for g, v in gain.items() if v >= least}
    return names[chosen]


def _parts(at: np.ndarray) -> Iterator[np.ndarray]:
    """Bounds of runs of texts that hold about TRAIN_PART bytes, or one longer text."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + TRAIN_PART, "right")) - 1)
        yield at[low : high + 1]
        low = high


def _all_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """features() of many texts, part by part into one array: words x kinds, and words' bounds by text."""
    out, bounds, n = np.empty((len(raw) // 2 + len(at), len(KINDS)), np.uint64), [np.zeros(1, np.int64)], 0
    for part in _parts(at):
        h, b, _, _ = features(raw[part[0] : part[-1]], part - part[0])
        out[n : n + len(h)] = h
        bounds.append(n + b[1:])
        n += len(h)
    return out[:n], np.concatenate(bounds)


def fit(texts: list[str], toxic: np.ndarray, ratio: float = 1.0, seed: int = 10) -> Model | None:
    """A model of labelled texts, or None without both classes or without a marker."""
    if not toxic.any() or toxic.all():
        return None
    raw, at = text_buffer(pa.array(texts, pa.large_string()))
    h, bounds = _all_features(raw, at)
    found = Lookup(markers(h, bounds, toxic))
    if not len(found.known):
        return None
    doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    label = np.zeros(len(h), bool)
    for j in range(len(KINDS)):
        label |= found(h[:, j]) > 0
    label &= toxic[doc]
    names, counts = np.unique(h[label], return_counts=True)
    names = names[(names != 0) & (counts >= 2)]
    counts = counts[(counts >= 2)][-len(names) :]
    known = np.sort(names[np.argsort(-counts, kind="stable")[:FEATURES]])
    find = Lookup(known)
    rng = np.random.default_rng(seed)
    positive = np.flatnonzero(label)
    some = rng.choice(positive, min(WINDOWS // 2, len(positive)), replace=False)
    other = rng.choice(len(h), min(WINDOWS, len(h)), replace=False)
    centre = np.concatenate([some, other])
    place = centre[:, None] - rng.integers(0, WINDOW, len(centre))[:, None] + np.arange(WINDOW)
    ok = (place >= bounds[doc[centre]][:, None]) & (place < bounds[doc[centre] + 1][:, None])
    place = np.clip(place, 0, len(h) - 1)
    x = np.where(ok[:, :, None], np.stack([find(h[place, j]) for j in range(len(KINDS))], axis=2), 0)
    y = np.where(ok, label[place], False)
    weights, transition, start = _learn(x, y, ok, len(known))
    model = Model(known, weights, transition, start)
    del h, x, y, ok, place
    evidence = []
    for part in _parts(at):
        m, bounds, _, _ = model.tag(raw[part[0] : part[-1]], part - part[0])
        evidence.append(_evidence(m, bounds))
    model.document = _logistic(np.concatenate(evidence), toxic, ratio)
    return model


def _learn(x: np.ndarray, y: np.ndarray, ok: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum conditional likelihood with a small penalty, by Adam over all windows. x: features' places, 0 for none."""
    rows, length, _ = x.shape
    theta = np.zeros(n + 1 + 4 + 2)
    theta[0] = -2.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    flat = x.reshape(-1, x.shape[2])
    begin = ok & ~np.concatenate([np.zeros((rows, 1), bool), ok[:, :-1]], axis=1)
    pair = ok[:, 1:] & ok[:, :-1]
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = (pair & (y[:, :-1] == i) & (y[:, 1:] == j)).sum()
    seen_start = np.array([(begin & ~y).sum(), (begin & y).sum()], float)
    tokens = max(1, ok.sum())
    for step in range(1, STEPS + 1):
        w, t, s = theta[: n + 1].copy(), theta[n + 1 : n + 5].reshape(2, 2), theta[n + 5 :]
        bias = w[0]
        w[0] = 0
        e = np.exp(np.clip(w[flat].sum(axis=1).reshape(rows, length) + bias, -30, 30))
        et, es = np.exp(t), np.exp(s)
        f = np.zeros((length, rows, 2))
        g = np.ones((length, rows, 2))
        prev = np.full((rows, 2), 0.5)
        for i in range(length):
            v = np.where(begin[:, i, None], es, prev @ et)
            v = v * np.stack([np.ones(rows), e[:, i]], axis=1)
            v = np.where(ok[:, i, None], v, prev)
            prev = f[i] = v / v.sum(axis=1, keepdims=True)
        for i in range(length - 2, -1, -1):
            v = (g[i + 1] * np.stack([np.ones(rows), e[:, i + 1]], axis=1)) @ et.T
            v = np.where(pair[:, i, None], v, 1.0)
            g[i] = v / v.sum(axis=1, keepdims=True)
        post = f * g
        post /= post.sum(axis=2, keepdims=True)
        p = post[:, :, 1].T
        diff = np.where(ok, y - p, 0.0)
        grad = np.zeros_like(theta)
        grad[: n + 1] = np.bincount(flat.ravel(), np.repeat(diff.ravel(), flat.shape[1]), n + 1)
        grad[0] = diff.sum()
        joint = f[:-1, :, :, None] * et * (g[1:] * np.stack([np.ones_like(e), e], axis=2).transpose(1, 0, 2)[1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        grad[n + 1 : n + 5] = (seen - (joint * pair.T[:, :, None, None]).sum(axis=(0, 1))).ravel()
        grad[n + 5 :] = seen_start - np.array([(begin * (1 - p)).sum(), (begin * p).sum()])
        grad = grad / tokens * 100 - 1e-4 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta + 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[: n + 1], theta[n + 1 : n + 5].reshape(2, 2), theta[n + 5 :]


def _logistic(x: np.ndarray, y: np.ndarray, ratio: float) -> np.ndarray:
    """Weights and intercept by Newton's method with a small penalty; clean documents weigh `ratio` times as much as
    toxic ones in all, as among all labelled documents."""
    a = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y, 1 / max(1, y.sum()), ratio / max(1, (~y).sum())) / (1 + ratio) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)) * len(y) / 100
        w = w + np.linalg.solve(hessian, a.T @ (weight * (y - p)) - 1e-2 * w * len(y) / 100)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple[str, int]], float]:
    """A bounded sample of labelled documents outside the held-out fold: TRAIN_EACH_CLASS of each class, by hash of the
    id. The ids are few by that bound, so they are broadcast and the documents aren't shuffled. A document is toxic if
    any of its labels is; labels other than 0 and 1 don't count. With the rows: clean documents to a toxic one."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 3, 1))
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [], 1.0
    share = F.when(F.col("y") == 1, min(1.0, TRAIN_EACH_CLASS / counts[1])).otherwise(min(1.0, TRAIN_EACH_CLASS / counts[0]))
    picked = known.where((F.xxhash64("i", F.lit(10)).cast("double") / 2.0**64 + 0.5) < share)  # about TRAIN_EACH_CLASS of each
    ids = spark.createDataFrame([(r["i"], r["y"]) for r in sorted(picked.collect())], "i long, y int")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(ids), "i")
    return [(r["t"] or "", r["y"]) for r in sorted(rows.collect(), key=lambda r: (r["i"], r["t"] or ""))], counts[0] / counts[1]


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted and the toxic spans (characters from 0, end excluded) of every whole text.

    A null or empty text, or one without words, has no spans and the score of no evidence; without a model every score
    is 0. Ids may be null or repeated; each row is scored by itself, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = part.num_rows
                raw, at = text_buffer(part.column(2))
                spans: list[list[dict]] = [[] for _ in range(n)]
                if own is None:
                    scores = np.zeros(n)
                else:
                    m, bounds, first, last = own.tag(raw, at)
                    scores = own.score(_evidence(m, bounds))
                    hit = np.flatnonzero(m >= SPAN_AT)
                    if len(hit):
                        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        doc = np.searchsorted(bounds, hit, "right") - 1
                        new = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(doc) != 0)])
                        for a, b in zip(new, np.append(new[1:], len(hit)), strict=True):
                            d, base = int(doc[a]), chars[at[doc[a]]]
                            spans[d].append({"start": int(chars[first[hit[a]]] - base), "end": int(chars[last[hit[b - 1]] + 1] - base), "score": float(m[hit[a:b]].max())})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= PREDICT_AT).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), modulus, rest).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), ROWS)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learns from the labelled documents outside the held-out fold (crc32 of the id modulo 3 is 1), scores all."""
    rows, ratio = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    model = fit([t for t, _ in rows], np.array([y == 1 for _, y in rows], bool), ratio) if rows else None
    return score(docs, model, id_col=id_col, text_col=text_col)
