"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that also starts in an earlier document.

Whole copies are told by their hash first and leave. Of the others:
1. Anchors: of the GRAM-byte strings that start in a window of LENGTH bytes the one with the least hash is its anchor.
   Equal windows have equal anchors, so a window can only repeat where its anchor's gram stands in two documents.
   Grams travel as packed hashes, dealt by hash; those of one document alone are dropped.
2. The rest go back to their documents, and each sends its context: all bytes that a window around it can cover.
3. The contexts of a gram meet. Equal ones are one, with their least document. Where a gram has different contexts,
   windows in one of them alone are cut off, and a suffix array (linear grouping) of what is left puts equal windows
   side by side: a run of suffixes that agree in LENGTH bytes is a window, its least document the one it stays in.
4. A document's covered ranges meet its text again, in the partitioning that step 2 made.

Rows go by a name of id and text, so ids may be null or repeated. All contexts of one gram meet in one task, as packed
arrays of about a hundred bytes each; a passage that very many documents hold word for word is bounded by that."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, U64, _powers, mix, row_name, saved, slices, text_buffer, tidy, without
from .common import cleaned as _cleaned
from .suffix_array import repeats, suffix_array

#: Shuffles of the job that has just ended go as well.
cleaned = partial(_cleaned, rounds=3)

LENGTH, GRAM = 50, 16
#: Gram starts in a window, and bytes of a context: before the gram, the gram, after it.
STARTS, SIDE = LENGTH - GRAM + 1, LENGTH - GRAM
WIDTH = 2 * SIDE + GRAM
LAST = (1 << 63) - 1  # stands for a null id: after all others
SLICE_BYTES, BATCH_GRAMS, ARRAY_BYTES = 2 << 20, 400_000, 1 << 19
#: Bytes of text whose grams and contexts one part is meant to hold, and tasks that share rows of one text.
PART_BYTES, SALTS = 64 << 20, 16
ROWS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of `width` values, by doubling."""
    step = 1
    while step * 2 <= width:
        a = f(a[:-step], a[step:])
        step *= 2
    return f(a[: len(a) - (width - step)], a[width - step :]) if step < width else a


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a gram from its first and last eight bytes."""
    return mix(mix(a.astype(np.uint64)) + b.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F)) | U64(1)


def anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram's hash, text) of the anchors of all windows of all texts."""
    n, sizes = len(raw), np.diff(at)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.ascontiguousarray(raw)
    grams = n - GRAM + 1
    h = _gram(np.ndarray((grams,), "<u8", whole.data, 0, (1,)), np.ndarray((grams,), "<u8", whole.data, 8, (1,)))
    least = _slide(h, STARTS, np.minimum)
    inside = np.zeros(len(least) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - LENGTH + 1, -1)
    least[np.cumsum(inside)[:-1] == 0] = 0  # windows across the bounds of texts
    edge = np.zeros(STARTS - 1, np.uint64)
    chosen = _slide(np.concatenate([edge, least, edge]), STARTS, np.maximum)
    place = np.flatnonzero(chosen == h)
    return place, h[place], np.searchsorted(at, place, "right") - 1


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False)


_GRAMS = pa.schema([("part", pa.int32()), ("grams", pa.binary()), ("place", pa.binary()), ("flags", pa.binary()), ("rows", pa.binary())])


def _send_grams(parts: int):
    def packed(gram: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        gram, doc = gram[fresh], doc[fresh]
        first = np.ones(len(gram), bool)
        first[1:] = gram[1:] != gram[:-1]
        shared = np.zeros(len(gram), bool)
        shared[:-1] = first[:-1] & ~first[1:]
        to = np.where(first, (gram >> U64(40)) % U64(parts), mix(doc.view(np.uint64)) % U64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(parts + 1))
        rows = []
        for p in range(parts):
            own = order[bounds[p] : bounds[p + 1]]
            if len(own):
                used, local = np.unique(doc[own], return_inverse=True)
                flags = shared[own].astype(np.uint8) | ((~first[own]).astype(np.uint8) << 1)
                rows.append((p, gram[own].tobytes(), local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes(), flags.tobytes(), used.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _GRAMS, strict=True)], schema=_GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                _, gram, doc = anchors(*text_buffer(part.column(1)))
                if len(gram):
                    held.append((gram, part.column(0).to_numpy()[doc]))
                if sum(len(g) for g, _ in held) >= BATCH_GRAMS:
                    yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held.clear()
        if held:
            yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, gram) of the grams that stand in two rows or more."""
    cols: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for r in batch.to_pylist():
            docs = np.frombuffer(r["rows"], np.int64)
            cols[0].append(np.frombuffer(r["grams"], np.uint64))
            cols[1].append(docs[np.frombuffer(r["place"], np.uint16 if len(docs) <= 1 << 16 else np.uint32)])
            cols[2].append(np.frombuffer(r["flags"], np.uint8))
    if not cols[0]:
        return
    gram, doc, flag = (np.concatenate(c) for c in cols)
    keep = flag & 2 != 0
    tied = np.flatnonzero(~keep)
    tied = tied[np.argsort(gram[tied], kind="stable")]
    new = np.ones(len(tied), bool)
    new[1:] = gram[tied][1:] != gram[tied][:-1]
    start = np.flatnonzero(new)
    if len(start):
        several = (np.diff(np.append(start, len(tied))) > 1) | (np.maximum.reduceat(flag[tied] & 1, start) > 0)
        keep[tied] = several[np.cumsum(new) - 1]
    i = np.flatnonzero(keep)
    for low in range(0, len(i), 200_000):
        cut = i[low : low + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(gram[cut].view(np.int64))], ["row", "gram"])


_CONTEXTS = pa.schema([("part", pa.int32()), ("head", pa.binary()), ("docs", pa.binary()), ("bytes", pa.binary())])
#: One context on its way: its document's place in a list, the gram's place, bytes before and after it that count. The
#: gram's hash is taken from the bytes again. The list holds ids and names of rows, as an id may be repeated or null.
_SENT = np.dtype([("local", "<u2"), ("place", "<u4"), ("before", "u1"), ("after", "u1")])
_HEAD = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("place", "<u4"), ("before", "u1"), ("after", "u1")])
_MOST_DOCS = 1 << 16


def _send_contexts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                raw, at = text_buffer(part.column(1))
                place, gram, doc = anchors(raw, at)
                grams = part.column(2)
                known = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(len(grams)), pa.compute.list_value_length(grams).fill_null(0).to_numpy())
                use = np.isin(mix(gram + doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), mix(known + owner.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
                place, gram, doc = place[use], gram[use], doc[use]
                if not len(place):
                    continue
                docs, tags = _ids(part.column(0)), part.column(3).to_numpy()
                padded = np.concatenate([np.zeros(SIDE, np.uint8), raw, np.zeros(WIDTH, np.uint8)])
                head = np.zeros(len(place), _SENT)
                head["place"] = place - at[doc]
                head["before"] = np.minimum(SIDE, place - at[doc])
                head["after"] = np.minimum(SIDE, at[doc + 1] - place - GRAM)
                to = ((gram >> U64(40)) % U64(parts)).astype(np.int64)
                order = np.lexsort((gram, to))
                bounds = np.searchsorted(to[order], np.arange(parts + 1))
                for p in range(parts):
                    mine = order[bounds[p] : bounds[p + 1]]
                    for low in range(0, len(mine), _MOST_DOCS):
                        own = mine[low : low + _MOST_DOCS]
                        used, local = np.unique(doc[own], return_inverse=True)
                        head["local"][own] = local
                        text = padded[place[own][:, None] + np.arange(WIDTH)]
                        listed = np.concatenate([docs[used], tags[used]]).astype("<i8")
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (head[own], listed, text))], schema=_CONTEXTS)

    return run


def _ranges(head: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, tag, start, end) of the ranges that contexts have from earlier documents; all contexts of each gram here."""
    n = len(head)
    column = np.arange(WIDTH)
    before, after = head["before"].astype(np.int64), head["after"].astype(np.int64)
    text = np.where((column >= SIDE - before[:, None]) & (column < SIDE + GRAM + after[:, None]), text, 0)
    up, down = _powers(WIDTH + 1)
    name = np.zeros(n, np.uint64)
    sums = np.zeros((n, WIDTH + 1), np.uint64)
    np.cumsum((text.astype(np.uint64) + U64(1)) * up[:WIDTH], axis=1, out=sums[:, 1:])
    name = mix(sums[:, -1] + mix(head["gram"]) + (before * 256 + after).astype(np.uint64))
    order = np.lexsort((head["doc"], name))
    new = np.ones(n, bool)
    new[1:] = name[order][1:] != name[order][:-1]
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(new) - 1
    rep = order[new]  # the context of the least document of each kind
    least = head["doc"][rep]
    several = np.zeros(len(rep), bool)
    np.logical_or.at(several, kind, head["doc"] != least[kind])
    low, high = SIDE - before[rep], after[rep]  # windows of a context start at columns low to high

    # windows that two kinds of one gram share, by hash; the suffix array decides on what is left
    width = SIDE + 1
    starts = np.arange(width)
    valid = (starts >= low[:, None]) & (starts <= high[:, None])
    per_gram = np.unique(head["gram"][rep], return_inverse=True)[1]
    mixed = np.flatnonzero(np.bincount(per_gram)[per_gram] > 1)
    shared = np.zeros((len(rep), width), bool)
    if len(mixed):
        window = (sums[rep[mixed]][:, LENGTH : LENGTH + width] - sums[rep[mixed]][:, :width]) * down[:width]
        window = mix(window + mix(head["gram"][rep[mixed]])[:, None])
        some = np.flatnonzero(valid[mixed].ravel())
        values = window.ravel()[some]
        order = np.argsort(values, kind="stable")
        twin = np.zeros(len(values), bool)
        same = values[order][1:] == values[order][:-1]
        twin[order[1:][same]] = True
        twin[order[:-1][same]] = True
        flat = np.zeros(len(mixed) * width, bool)
        flat[some[twin]] = True
        shared[mixed] = flat.reshape(len(mixed), width)
    first = np.where(shared.any(axis=1), shared.argmax(axis=1), 0)
    last = np.where(shared.any(axis=1), width - 1 - shared[:, ::-1].argmax(axis=1), -1)
    earliest = np.full((len(rep), width), LAST)  # the least document that has each window
    cut = np.flatnonzero(last >= first)
    pieces: dict[tuple[int, bytes], list[int]] = {}
    for r in cut.tolist():
        pieces.setdefault((int(per_gram[r]), text[rep[r], first[r] : last[r] + LENGTH].tobytes()), []).append(r)
    names = list(pieces)
    alone = {}
    for g, _ in names:
        alone[g] = alone.get(g, 0) + 1
    block, size = [], 0
    for i, (g, piece) in enumerate(names):
        owners = pieces[names[i]]
        if alone[g] == 1:  # what the gram's contexts share is one string
            earliest[owners, first[owners[0]] : last[owners[0]] + 1] = min(least[owners])
            continue
        block.append((piece, owners))
        size += len(piece) + 1
        if size >= ARRAY_BYTES and (i + 1 == len(names) or names[i + 1][0] != g):
            _order(block, earliest, least, first)
            block, size = [], 0
    if block:
        _order(block, earliest, least, first)

    doc, kinds = head["doc"], kind
    own = several[kinds] & (doc > least[kinds])  # the whole context stands in an earlier document
    begin = np.where(own, low[kinds], WIDTH)
    end = np.where(own & (low <= high)[kinds], high[kinds] + LENGTH, 0)
    out = [(doc[i], head["tag"][i], begin[i], end[i], head["place"][i]) for i in (np.flatnonzero(end > begin),)]
    rest = np.flatnonzero(~own & (last[kinds] >= 0))
    got = earliest[kinds[rest]] < doc[rest][:, None]
    edge = np.zeros((len(rest), 1), bool)
    turn = np.diff(np.concatenate([edge, got, edge], axis=1).astype(np.int8), axis=1)
    i, a = np.nonzero(turn == 1)
    _, b = np.nonzero(turn == -1)
    out.append((doc[rest[i]], head["tag"][rest[i]], a, b + LENGTH - 1, head["place"][rest[i]]))
    doc, tag, begin, end, place = (np.concatenate(c) for c in zip(*out, strict=True))
    return doc, tag, place.astype(np.int64) - SIDE + begin, place.astype(np.int64) - SIDE + end


def _order(block: list[tuple[bytes, list[int]]], earliest: np.ndarray, least: np.ndarray, first: np.ndarray) -> None:
    """Least documents of the windows of strings of shared windows, from the suffix array of them all."""
    sizes = np.array([len(p) + 1 for p, _ in block])
    begin = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.int64)
    for (piece, _), b in zip(block, begin, strict=True):
        symbols[b : b + len(piece)] = np.frombuffer(piece, np.uint8)
    symbols += 1
    symbols[begin + sizes - 1] = 0
    order = suffix_array(symbols)
    equal = repeats(symbols, order, LENGTH)
    string = np.searchsorted(begin, order, "right") - 1
    inner = order - begin[string]
    fits = inner + LENGTH < sizes[string]
    run = np.concatenate([[0], np.cumsum(~equal[:-1])]) if len(order) > 1 else np.zeros(1, np.int64)
    doc = np.array([min(least[o]) for _, o in block], np.int64)[string]
    doc = np.where(fits, doc, LAST)
    best = np.full(int(run[-1]) + 1, LAST)
    np.minimum.at(best, run, doc)
    for s, i, d in zip(string[fits].tolist(), inner[fits].tolist(), best[run[fits]].tolist(), strict=True):
        for r in block[s][1]:
            earliest[r, first[r] + i] = d


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heads, texts = [], []
    for batch in batches:
        for r in batch.to_pylist():
            sent, text = np.frombuffer(r["head"], _SENT), np.frombuffer(r["bytes"], np.uint8).reshape(-1, WIDTH)
            docs, tags = np.frombuffer(r["docs"], "<i8").reshape(2, -1)
            head = np.zeros(len(sent), _HEAD)
            for name in ("place", "before", "after"):
                head[name] = sent[name]
            head["doc"], head["tag"] = docs[sent["local"]], tags[sent["local"]]
            middle = np.ascontiguousarray(text[:, SIDE : SIDE + GRAM]).view("<u8")
            head["gram"] = _gram(middle[:, 0], middle[:, 1])
            heads.append(head)
            texts.append(text)
    if not heads:
        return
    head, text = np.concatenate(heads), np.concatenate(texts)
    del heads, texts
    order = np.argsort(head["gram"], kind="stable")
    head = head[order]
    grams = np.flatnonzero(np.r_[True, head["gram"][1:] != head["gram"][:-1]])
    at = 0
    while at < len(head):  # whole grams, some thousand contexts at a time
        stop = np.searchsorted(grams, at + 20_000)
        stop = int(grams[stop]) if stop < len(grams) else len(head)
        doc, tag, begin, end = _ranges(head[at:stop], text[order[at:stop]])
        at = stop
        if len(doc):
            o = np.lexsort((begin, tag, doc))  # ranges of one document that touch become one
            doc, tag, begin, end = doc[o], tag[o], begin[o], end[o]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (begin[1:] > end[:-1])
            s = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(tag[s]), pa.array(begin[s].astype(np.int32)), pa.array(np.maximum.reduceat(end, s).astype(np.int32))], ["row", "begin", "end"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            raw, at = text_buffer(part.column(1))
            out = []
            for d, (begins, ends) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                mine = raw[at[d] : at[d + 1]]
                if not begins:
                    out.append((len(mine), 0, 0, hashlib.sha256(mine.tobytes()).hexdigest()))
                    continue
                level = np.zeros(len(mine) + 1, np.int32)
                np.add.at(level, begins, 1)
                np.add.at(level, ends, -1)
                gone = np.cumsum(level)[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(mine), int(gone.sum()), spans, hashlib.sha256(mine[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row.

    Texts are UTF-8 bytes; null is empty. A null id counts as the greatest one. Rows that repeat an id don't
    remove each other's bytes; each is one row of the result. Texts of fewer than LENGTH bytes lose nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", row_name("id", "text"))
    size = F.octet_length("text")
    total = rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    hashed = rows.where(size >= LENGTH).select("doc", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), size.cast("long").alias("size"))
    least = saved(hashed.groupBy("sha").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").select("sha", "least"))
    if least.count() <= BROADCAST_IDS:
        copies = hashed.join(F.broadcast(least), "sha").where("doc > least")
    else:  # a text that very many rows have is dealt by salt as well
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        copies = hashed.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"]).where("doc > least")
    # a row is a copy by its text, an id may be repeated: only ids all of whose rows are copies leave here
    rows_of = hashed.join(copies.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.count("*").alias("all"))
    full = copies.groupBy("doc").agg(F.count("*").alias("n")).join(rows_of, "doc").where("n = all").select("doc")
    short = rows.where(size < LENGTH).select("doc").distinct()
    gone = full.join(short, "doc", "left_anti")

    gone = saved(gone.where(F.col("doc") != LAST))
    copied = copies.join(gone, "doc", "left_semi")
    empty = hashlib.sha256(b"").hexdigest()
    copied = copied.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_bytes"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"))

    rest = without(rows, gone, "doc")
    grams = rest.select("row", "text").mapInArrow(tidy(_send_grams(parts)), "part int, grams binary, place binary, flags binary, rows binary")
    grams = saved(grams.repartitionById(parts, F.col("part")).mapInArrow(tidy(_shared_grams), "row long, gram long"))
    cleaned(spark)  # the hashes of all anchors go before contexts travel
    by_row = grams.groupBy("row").agg(F.collect_list("gram").alias("grams"))
    # both joins read id, text and row, so that texts travel once and the second join finds them where the first had them
    contexts = rest.join(by_row.hint("merge"), "row").select("id", "text", "grams", "row").mapInArrow(tidy(_send_contexts(parts)), "part int, head binary, docs binary, bytes binary")
    ranges = contexts.repartitionById(parts, F.col("part")).mapInArrow(tidy(_covered), "row long, begin int, end int")
    ranges = ranges.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("own"))
    final = rest.join(ranges.hint("merge"), "row", "left").select("id", "text", F.col("own.begin").alias("begins"), F.col("own.end").alias("ends"))
    return final.mapInArrow(tidy(_kept), ROWS).unionByName(copied)
