"""Token counts under a unigram tokenizer: Aho-Corasick finds the vocabulary's matches, one pass of dynamic
programming carries best score and piece count; no segmentation is built.

The tokenizer is Unigram behind a Metaspace pre-tokenizer (a word is a space and what follows it), so a text's count
is the sum over its words; words repeat, and each worker keeps the counts of those it has met."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ROWS = "doc_id long, n_tokens long, score double"
#: The mark of a space in pieces, and how far below the worst piece an unknown character scores. Fixed values.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
CACHE_ENTRIES = 400_000


class UnigramCounter:
    """Counts of words under pieces [(text, score)].

    Tie rules: among equal scores for one end the piece that starts first wins (a later one must be greater). A
    character that is no piece itself is unknown: worst score less a penalty; a run of them is one piece, or with
    byte fallback a piece for each byte."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        for piece, score in pieces:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word."""
        if self.single.issuperset(word):
            return self.plain(word)
        n = len(word)
        best, count, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.found.iter(word):
            at[end].append(match)
        for e in range(1, n + 1):
            top = None
            for size, score in sorted(at[e - 1], reverse=True):
                value = score + best[e - size]
                if top is None or value > top:
                    top, start, unknown = value, e - size, False
            if word[e - 1] not in self.single:
                value = self.unknown + best[e - 1]
                if top is None or value > top:
                    top, start, unknown = value, e - 1, True
            best[e] = top
            odd[e] = unknown
            if not unknown:
                count[e] = count[start] + 1
            elif self.bytes:
                count[e] = count[start] + len(word[e - 1].encode())
            else:
                count[e] = count[start] + (not odd[start])
        return count[n], best[n]

    def plain(self, word: str) -> tuple[int, float]:
        """A word without unknown characters. The automaton gives the matches of an end longest first."""
        best: list[float | None] = [0.0] + [None] * len(word)
        count = [0] * (len(word) + 1)
        for end, (size, score) in self.found.iter(word):
            value = best[end + 1 - size] + score
            if best[end + 1] is None or value > best[end + 1]:
                best[end + 1] = value
                count[end + 1] = count[end + 1 - size] + 1
        return count[-1], best[-1]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        total, score = 0, 0.0
        words = text.replace(SPACE, " ").split(" ")  # the mark itself counts as a space
        if not words[0] and len(words) > 1:  # the text begins with a space, which is its own first mark
            words = words[1:]
        for word in words:
            got = known.get(word)
            if got is None:
                got = known[word] = self.word(SPACE + word)
            total += got[0]
            score += got[1]
        return total, score


_COUNTERS: dict[str, UnigramCounter] = {}


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(load_pieces(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the best segmentation's score for every whole text, row by row, without a shuffle.

    A null or empty text has 0 tokens and score 0; a null id stays null; repeated rows give repeated rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [own.text(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, ROWS)
