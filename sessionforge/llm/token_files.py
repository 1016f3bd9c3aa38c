"""Token-ID / binary output: flat unsigned id files with 64-bit document offsets, read by memory mapping.

Format of a data set folder, little-endian throughout:
  ids-NNNNN.bin   the ids of the shard's documents end to end, unsigned 16 bit where every id fits, else 32 bit
  docs-NNNNN.bin  int64: how many documents have no id, then the documents' ids, ascending; those without one come
                  first, as 0
  at-NNNNN.bin    int64 offsets, one more than documents, counted from the first id of the whole data set
Shards follow each other in document order. A shard's base is the prefix sum of the shards before it; those counts,
one row a shard, are all that reaches the driver.

A shard is written under a name of the attempt's own and then renamed, so a task that runs again, on any executor,
leaves the same files. Workers write and read through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import mmap
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache, scratch_dir, slices, tidy

MANIFEST = "shard int, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
#: Encoded parts that a worker fills before it sets them aside: those met again come back, the rest goes at the next turn.
CACHE_ENTRIES = 400_000
_BEFORE_SPACE = re.compile(r"\s ")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri)


def _renamed(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    try:
        fs.move(temporary, final)
    except OSError:  # a store whose rename doesn't replace: an earlier attempt's file is the same
        fs.delete_file(final)
        fs.move(temporary, final)


class _Parts(dict):
    """Ids of a text's parts (what follows a space, that space included), filled as parts are met."""

    def __init__(self, owner: Encoder, before: str):
        super().__init__()
        self.owner, self.before, self.aside = owner, before, {}

    def __missing__(self, part: str) -> bytes:
        if (got := self.aside.get(part)) is None:
            got = self.owner.part(self.before + part)
        if len(self) >= CACHE_ENTRIES:
            self.aside = dict(self)
            self.clear()
        self[part] = got
        return got


class Encoder:
    """Byte-level BPE ids of texts, as bytes of unsigned integers, equal to Tokenizer.encode(add_special_tokens=False).

    The pre-tokeniser never joins a space to a character before it that isn't white space, so a text without white
    space before a space is the sum of its parts cut before each space; parts repeat, and their ids are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        kept = json.loads(self.tokenizer.to_str())["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kept["merges"]]
        self.model = BPE(kept["vocab"], merges, cache_capacity=0)  # the words are kept here
        chars = ByteLevel.alphabet()
        shown = {b: chr(b) for b in range(256) if chr(b) in chars}
        rest = (b for b in range(256) if b not in shown)
        self.shown = shown | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        packed = struct.Struct("<H" if self.kind.itemsize == 2 else "<I").pack
        self.codes = [packed(i) for i in range(max(kept["vocab"].values()) + 1)]
        self.first, self.later, self.words = _Parts(self, ""), _Parts(self, " "), {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def bytes(self, text: str) -> str:
        """The characters that stand for a text's bytes in the vocabulary."""
        return "".join(map(self.shown.__getitem__, text.encode()))

    def word(self, shown: str) -> bytes:
        codes = self.codes
        return b"".join([codes[t.id] for t in self.model.tokenize(shown)])

    def part(self, text: str) -> bytes:
        spaced = text[:1] == " "
        core = text[1:] if spaced else text
        if core.isalpha():  # letters are one word, with the space before them; its parts keep it
            if core.isascii():  # letters stand for themselves
                return self.word(self.shown[32] + core if spaced else core)
            return self.word(self.bytes(text))
        if core[-1:] in (",", ".") and core[:-1].isalpha():
            return (self.later if spaced else self.first)[core[:-1]] + self._kept(core[-1])
        return b"".join([self._kept(word) for word, _ in self.cut(text)])

    def _kept(self, shown: str) -> bytes:
        words = self.words
        if (got := words.get(shown)) is None:
            if len(words) >= CACHE_ENTRIES:
                words.clear()
            got = words[shown] = self.word(shown)
        return got

    def __call__(self, text: str) -> bytes:
        if _BEFORE_SPACE.search(text) or any(t in text for t in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = cache()


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encodes every whole text, writes the data set and returns its manifest: shard, n_docs, n_ids, base.

    Rows are dealt by range of (id, text) and sorted, so shards ascend. A null or empty text is the end id alone; rows
    with a null id come first; any id, negative ones too, is kept as it is; repeated rows are written as often as they
    occur. No rows: a manifest without rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, top = _opened(out)
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        ids, at, total, nulls, sink = [], [np.zeros(1, np.int64)], 0, 0, None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                if sink is None:
                    fs.create_dir(top, recursive=True)
                    sink = fs.open_output_stream(f"{top}/.{attempt}.ids")
                coded = [enc(t or "") for t in part.column(1).to_pylist()]
                counts = np.array([len(c) // enc.kind.itemsize + 1 for c in coded], np.int64)
                sink.write(b"".join(x for c in coded for x in (c, end)))
                nulls += part.column(0).null_count
                ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                at.append(total + np.cumsum(counts))
                total = int(at[-1][-1])
        if sink is None:
            return
        sink.close()
        _renamed(fs, f"{top}/.{attempt}.ids", f"{top}/ids-{shard:05d}.bin")
        for name, data in (("docs", np.concatenate([[nulls], *ids])), ("local", np.concatenate(at))):
            with fs.open_output_stream(f"{top}/.{attempt}.{name}") as f:
                f.write(data.astype("<i8").tobytes())
            _renamed(fs, f"{top}/.{attempt}.{name}", f"{top}/{name}-{shard:05d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([sum(map(len, ids))], pa.int64()), pa.array([total], pa.int64())], ["shard", "n_docs", "n_ids"])

    def rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(out)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                with fs.open_input_stream(f"{top}/local-{shard:05d}.bin") as f:
                    local = np.frombuffer(f.read(), "<i8")
                name = f"{top}/.{uuid.uuid4().hex}.at"
                with fs.open_output_stream(name) as f:
                    f.write((local + base).astype("<i8").tobytes())
                _renamed(fs, name, f"{top}/at-{shard:05d}.bin")
            yield batch

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    counts = sorted(tuple(r) for r in ranged.mapInArrow(tidy(write), MANIFEST).collect())
    base, manifest = 0, []
    for shard, n_docs, n_ids in counts:
        manifest.append((shard, n_docs, n_ids, base))
        base += n_ids
    schema = MANIFEST + ", base long"
    listed = spark.createDataFrame(manifest, schema)
    listed.repartition(max(1, min(len(manifest), spark.sparkContext.defaultParallelism * 4))).mapInArrow(rebase, schema).count()
    return listed


def _mapped(fs: pafs.FileSystem, path: str, kind: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where it is a mounted one, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            if not f.seek(0, 2):
                return np.zeros(0, kind)
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(spark: SparkSession, out: str, manifest: DataFrame, width: int) -> DataFrame:
    """Reads a data set back: for each document its place, length and the crc32 of its ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(out)
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                nulls, docs = np.split(_mapped(fs, f"{top}/docs-{shard:05d}.bin", np.dtype("<i8")), [1])
                absent = np.arange(len(docs)) < nulls[0]
                at = _mapped(fs, f"{top}/at-{shard:05d}.bin", np.dtype("<i8"))
                ids = _mapped(fs, f"{top}/ids-{shard:05d}.bin", kind)
                local = at - at[0]
                crc = np.fromiter((zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(local[:-1], local[1:], strict=True)), np.int64, len(docs))
                for low in range(0, len(docs), 50_000):
                    cut = slice(low, low + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(docs[cut], mask=absent[cut]), pa.array(at[:-1][cut]), pa.array(np.diff(at)[cut]), pa.array(crc[cut]), pa.array(np.full(len(docs[cut]), shard, np.int32))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    shards = manifest.count()
    return manifest.select("shard").repartition(max(1, shards), "shard").mapInArrow(tidy(read), ROWS)


def token_files(docs: DataFrame, tokenizer: str, out: str | None = None) -> DataFrame:
    """Writes docs as a token data set (a scratch one unless `out` is given) and reads it back."""
    out = out or scratch_dir(docs.sparkSession)
    manifest = write_tokens(docs, out, tokenizer)
    return read_tokens(docs.sparkSession, out, manifest, encoder(tokenizer).kind.itemsize)
