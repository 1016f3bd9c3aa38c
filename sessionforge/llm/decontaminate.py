"""Benchmark decontamination: which test items' shingles are contained in which documents.

Items are dealt into size classes (8, 16, 32, ... shingles). For each class a document is read in windows of two
adjacent blocks of that many shingles, so an item lies whole in some window of at most four times its size, and
MinHash works on sets of like size however long the document is. A window and an item that agree in any one of
MINHASHES minima (bands of one row) are a candidate: an item of which 0.8 is present agrees in a minimum with
probability 0.19 at least, and is missed by all 64 with 2e-6 at most; items of one or two shingles, for which
windows are too wide, are looked up by those. Candidates are verified against all shingles of the whole document."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_table, cache, distinct_sets, mix, row_name, saved, shingle_hashes, slices, text_buffer, tidy, without, word_hashes

WORDS, THRESHOLD, MINHASHES, LEAST_CLASS = 5, 0.8, 64, 8
#: Items of so few shingles are looked up by each of them.
TINY = 2
#: Items (and their bytes) that one pass over the documents looks for; more items take more passes.
PASS_ITEMS, PASS_BYTES = 50_000, 32 << 20
ROWS = "doc_id long, item_id long, n_item_shingles int, n_shared int, containment double"
#: A word is a run of letters, digits and bytes above 127.
ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789"
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, MINHASHES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


class Items:
    """Shingle sets of the items and, for each size class, their minima by hash function."""

    def __init__(self, ids: list, texts: list[str], k: int):
        raw, at = text_buffer(pa.array(texts, pa.string()))
        h, bounds = distinct_sets(*shingle_hashes(*word_hashes(raw, at, byte_table(ALPHABET)), k))
        self.k, self.ids = k, ids
        self.sets = [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        groups: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(self.sets):
            if len(s) > TINY:
                groups[max(LEAST_CLASS, 1 << (len(s) - 1).bit_length())].append(i)
        self.tiny: dict[int, list[int]] = defaultdict(list)  # windows are too wide for items of one or two shingles
        for i, s in enumerate(self.sets):
            for x in s.tolist() if len(s) <= TINY else ():
                self.tiny[x].append(i)
        self.tiny_known = np.array(sorted(self.tiny), np.uint64)
        self.classes = {}
        for u, members in sorted(groups.items()):
            found = []
            for a in _multipliers():
                least = np.array([(self.sets[i] * a).min() for i in members], np.uint64)
                order = np.argsort(least, kind="stable")
                bits = np.zeros(1 << 16, bool)
                bits[least & U64(0xFFFF)] = True
                found.append((least[order], np.array(members)[order], bits))
            self.classes[u] = found

    def candidates(self, h: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that agree in a minimum of some window."""
        sizes = np.diff(at)
        blocks = -(-sizes // LEAST_CLASS)
        first = np.concatenate([[0], np.cumsum(blocks)])
        if not first[-1]:
            return set()
        out: set[tuple[int, int]] = set()
        if len(self.tiny_known):
            near = np.minimum(np.searchsorted(self.tiny_known, h), len(self.tiny_known) - 1)
            for place in np.flatnonzero(self.tiny_known[near] == h).tolist():
                out.update((int(np.searchsorted(at, place, "right") - 1), i) for i in self.tiny[int(h[place])])
        if not self.classes:
            return out
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = first[doc] * LEAST_CLASS + (np.arange(len(h)) - at[doc])
        padded = np.full(int(first[-1]) * LEAST_CLASS, _TOP)
        levels, owner, n = [], np.repeat(np.arange(len(sizes)), blocks), blocks
        u = LEAST_CLASS
        while u <= max(self.classes):
            levels.append((u, owner, n))
            u *= 2
            n = -(-n // 2)
            owner = np.repeat(np.arange(len(sizes)), n)
        for j, a in enumerate(_multipliers()):
            padded[place] = h * a
            least = padded
            for _ in range(LEAST_CLASS.bit_length() - 1):
                least = np.minimum(least[0::2], least[1::2])
            for level, (u, owner, n) in enumerate(levels):
                if level:
                    before = levels[level - 1][2]
                    inner = np.concatenate([[0], np.cumsum(before)[:-1]])
                    at_block = inner[owner] + 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
                    least = np.minimum.reduceat(least, at_block)
                if u in self.classes:
                    window = least.copy()
                    same = owner[1:] == owner[:-1]
                    window[:-1][same] = np.minimum(least[:-1][same], least[1:][same])
                    known, members, bits = self.classes[u][j]
                    for w in np.flatnonzero(bits[window & U64(0xFFFF)]):
                        low, high = np.searchsorted(known, window[w], "left"), np.searchsorted(known, window[w], "right")
                        out.update((int(owner[w]), int(i)) for i in members[low:high])
        return out

    def matches(self, raw: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of all verified pairs."""
        h, bounds = shingle_hashes(*word_hashes(raw, at, byte_table(ALPHABET)), self.k)
        out, sets = [], {}
        for d, i in sorted(self.candidates(h, bounds)):
            if d not in sets:
                sets[d] = np.unique(h[bounds[d] : bounds[d + 1]])
            shared = int(np.isin(self.sets[i], sets[d], assume_unique=True).sum())
            if shared >= threshold * len(self.sets[i]):
                out.append((d, i, shared))
        return out


_ITEMS: dict[int, Items] = cache()


def _items(ids: list, texts: list[str], k: int) -> Items:
    key = hash((tuple(ids), tuple(texts), k))
    if key not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[key] = Items(ids, texts, k)
    return _ITEMS[key]


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item with at least `threshold` of the item's distinct k-word shingles in the document.

    An item or document of 1 to k - 1 words has one shingle, of all its words; without words it matches nothing. Null
    texts are empty; null ids stay null; repeated rows match each for themselves. No items or documents: no rows.
    Documents are read once for each pass's worth of items and never shuffled; with several passes each is run and
    written before the next one's items are read, so the driver holds one pass's items."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.lower(F.col(item_text_col)).alias("text"))
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    out = None
    for p in range(passes):
        got = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).collect() if passes > 1 else wanted.collect()
        sent = spark.sparkContext.broadcast(([r["item_id"] for r in got], [r["text"] or "" for r in got]))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = _items(*sent.value, k)
            for batch in batches:
                for part in slices(batch, "text"):
                    if not own.classes and not own.tiny:
                        continue
                    found = own.matches(*text_buffer(part.column(1)), threshold)
                    ids = part.column(0).take(pa.array([d for d, _, _ in found], pa.int64()))
                    sizes = [len(own.sets[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([own.ids[i] for _, i, _ in found], pa.int64()), pa.array(sizes, pa.int32()), pa.array([s for _, _, s in found], pa.int32()), pa.array([s / m for (_, _, s), m in zip(found, sizes, strict=True)], pa.float64())], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        part = rows.mapInArrow(tidy(look), ROWS)
        if passes > 1:
            part = saved(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows without the contaminated ones. Rows go by id and text together, so ids may be null or repeated."""
    rows = docs.withColumn("row_name__", row_name(id_col, text_col))
    found = contaminated(rows, items, id_col="row_name__", text_col=text_col, **options)
    return without(rows, found.select("doc_id"), "row_name__").select(*docs.columns)
