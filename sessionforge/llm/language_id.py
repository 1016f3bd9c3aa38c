"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language reads a text from left to right; whenever the longest match ends, a
phrase ends and the next begins. Phrases times log2(length of the labelled text) over the bytes read estimates the
cross entropy; the language with the least wins.

The automaton is a table over (state, symbol), so a step is one look-up: the next state, and whether a phrase ended.
Texts are read whole, in pieces of PIECE bytes (a phrase ends with its piece) that advance side by side in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cache, held_out, slices, text_buffer, tidy

ROWS = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"
PIECE, BLOCK = 512, 4096
#: Bytes of labelled text that a language's automaton is built from at most; about how many documents they come from
#: (by hash, so their number varies); and characters of each, in so many passages spread over its whole text.
TRAIN_BYTES, TRAIN_DOCS, TRAIN_EACH, PASSAGES = 32_768, 128, 2_048, 8
#: Bytes of tables that a worker keeps, and the least labelled text of a language: with many languages each gets less,
#: and tables beyond the bound are built again for each batch.
TABLE_BYTES, LEAST_BYTES = 96 << 20, 2_048
#: Evidence, in bytes of text, that the score counts at most; it keeps scores of long texts comparable.
EVIDENCE_BYTES = 64


def symbols() -> np.ndarray:
    """For each byte its symbol: letters a-z and bytes above 127 as they are, all else a space."""
    out = np.full(256, 32, np.uint8)
    for b in range(256):
        if 97 <= b <= 122 or b >= 128:
            out[b] = b
        elif 65 <= b <= 90:
            out[b] = b + 32
    return out


def normalised(raw: np.ndarray) -> np.ndarray:
    """Symbols of a text with runs of spaces as one."""
    s = symbols()[raw]
    if not len(s):
        return s
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
    return s[keep]


class CrossParser:
    """Tables of the suffix automata of all languages: {language: labelled text}."""

    def __init__(self, texts: dict[str, bytes]):
        self.names = sorted(texts)
        used = sorted({b for t in texts.values() for b in t})
        self.code = np.full(256, 1, np.uint8)  # 0: beyond the text's end; 1: met in no labelled text
        for i, b in enumerate(used):
            self.code[b] = i + 2
        self.width = len(used) + 2
        self.coded = [bytes(self.code[np.frombuffer(texts[n], np.uint8)]) for n in self.names]
        self.kept: dict[int, np.ndarray] = {}
        self.room = TABLE_BYTES
        self.bits = [math.log2(max(2, len(texts[n]))) for n in self.names]

    def table(self, k: int) -> np.ndarray:
        """The table of a language: kept while there is room, else built anew."""
        if k in self.kept:
            return self.kept[k]
        out = self._table(self.coded[k])
        if out.nbytes <= self.room:
            self.kept[k] = out
            self.room -= out.nbytes
        return out

    def _table(self, text: bytes) -> np.ndarray:
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        w = self.width
        rows = np.full((len(nexts), w), -1, np.int32)
        for s, d in enumerate(nexts):
            if d:
                rows[s, list(d)] = list(d.values())
        del nexts
        again = np.where(rows[0] >= 0, rows[0], 0)  # a phrase ends and the next one begins with this symbol
        out = np.where(rows >= 0, rows * np.int32(w * 2), again * np.int32(w * 2) + np.int32(1))
        out[:, 0] = np.arange(len(rows)) * w * 2
        out[0, 1:] = np.where(rows[0, 1:] >= 0, rows[0, 1:] * w * 2, 1)
        return out.ravel()

    def phrases(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) under each language (columns), and the symbols read of each text."""
        sym = symbols()[raw]
        keep = np.ones(len(sym), bool)
        if len(sym):
            keep[1:] = (sym[1:] != 32) | (sym[:-1] != 32)
            keep[at[:-1][at[:-1] < len(sym)]] = True
        before = np.concatenate([[0], np.cumsum(keep)])
        code, at = self.code[sym[keep]], before[at]
        sizes = np.diff(at)
        n = -(-sizes // PIECE)
        doc = np.repeat(np.arange(len(n)), n)
        first = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
        length = np.minimum(PIECE, at[doc + 1] - first)
        order = np.argsort(-length, kind="stable")
        counts = np.zeros((len(n), len(self.names)), np.int64)
        code = np.concatenate([code, np.zeros(PIECE, np.uint8)])
        for k, low in ((k, low) for k in range(len(self.names)) for low in range(0, len(order), BLOCK)):
            table = self.table(k) if not low else table
            own = order[low : low + BLOCK]
            steps = int(length[own[0]])
            place = np.arange(steps)[:, None]
            block = np.where(place < length[own], code[first[own] + place], 0).astype(np.int32)
            if steps:
                state, total = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
                for row in block:
                    got = table[state + row]
                    total += got & 1
                    state = got >> 1
                np.add.at(counts[:, k], doc[own], total + 1)
        return counts, sizes

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the index of its language, a score and its bits a byte; ties go to the first name."""
        counts, sizes = self.phrases(raw, at)
        bits = counts * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        weight = np.minimum(sizes, EVIDENCE_BYTES)[:, None]
        score = 1 / np.exp2(-(bits - least[:, None]) * weight).sum(axis=1)
        return best, score, least


_PARSERS: dict[int, CrossParser] = cache()


def parser(texts: dict[str, bytes]) -> CrossParser:
    key = hash(tuple(sorted(texts.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(texts)
    return _PARSERS[key]


def _passages(text: Column) -> Column:
    """A text, or of a longer one than TRAIN_EACH as many characters in PASSAGES passages from its begin to its end."""
    size = TRAIN_EACH // PASSAGES
    step = (F.length(text) - size) / (PASSAGES - 1)
    some = [F.substr(text, (F.floor(step * i) + 1).cast("int"), F.lit(size)) for i in range(PASSAGES)]
    return F.when(F.length(text) <= TRAIN_EACH, text).otherwise(F.concat_ws(" ", *some))


def labelled_texts(train: DataFrame, *, id_col: str, text_col: str, lang_col: str, train_bytes: int = TRAIN_BYTES) -> dict[str, bytes]:
    """A bounded sample of labelled text for each language: about TRAIN_DOCS documents by hash of the id, of each at
    most TRAIN_EACH characters in passages spread over the whole text. One count per language, then a filter: no rows
    are shuffled."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return {}
    spark = train.sparkSession
    share = spark.createDataFrame([(name, min(1.0, TRAIN_DOCS / n) * 2.0**63) for name, n in counts.items()], "l string, most double")
    order = F.xxhash64("i", F.lit(6)).cast("double") + F.lit(2.0**63)
    picked = rows.join(F.broadcast(share), "l").where(order / 2 <= F.col("most")).select("l", _passages(F.col("t")).alias("t"), order.alias("o"), "i").collect()
    each = max(LEAST_BYTES, min(train_bytes, TABLE_BYTES // (len(counts) * 4 * 48 * 2)))
    out: dict[str, bytes] = {}
    for r in sorted(picked, key=lambda r: (r["l"], r["o"], r["i"] is None, r["i"])):
        have = out.get(r["l"], b"")
        if len(have) < each:
            out[r["l"]] = (have + bytes(normalised(np.frombuffer(r["t"].lower().encode(), np.uint8))) + b" ")[:each]
    return out


def identify(docs: DataFrame, texts: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of every whole text, with the columns `keep`, without a shuffle.

    A null text, and one without a letter, is `und` with score 0. Without labelled text every document is `und`."""
    schema = docs.select(F.col(id_col).alias("doc_id"), *keep).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(texts) if texts else None
        for batch in batches:
            for part in slices(batch, "lowered__", 1 << 20):
                n = part.num_rows
                letters = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                raw, at = text_buffer(part.column(part.num_columns - 2))
                if own is None:
                    names, score, bits = np.array(["und"] * n, object), np.zeros(n), np.zeros(n)
                else:
                    best, score, bits = own.predict(raw, at)
                    names = np.where(letters, np.array(own.names, object)[best], "und")
                    score, bits = np.where(letters, score, 0.0), np.where(letters, bits, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(names, pa.string()), pa.array(score), pa.array(bits)], [f.name for f in schema])

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.lower(text).alias("lowered__"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters__")).mapInArrow(tidy(predict), schema)


def fitted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Labelled texts out of the documents outside the held-out fold."""
    return labelled_texts(docs.where(~held_out(F.col(id_col), 4, 2)), id_col=id_col, text_col=text_col, lang_col=lang_col)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from documents outside the held-out fold (crc32 of the id modulo 4 is 2) and predicts all documents."""
    texts = fitted(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col), 4, 2).alias("held_out"))
    return identify(rows, texts, keep=("held_out",))
