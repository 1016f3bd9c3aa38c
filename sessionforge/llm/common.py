"""Shared pieces of the training-data operators: scratch tables, Arrow batches and vectorised word hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: ASCII white space: space and 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sessionforge-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again with its schema."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that saved() wrote; df isn't read after that."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleaned(spark: SparkSession, rounds: int = 1) -> None:
    """Lets Spark delete the shuffle files of jobs that nothing refers to any more: its cleaner acts when the driver's
    memory is collected, which may otherwise be long after a loop's rounds.

    rounds: collections, a second apart. The first one still finds the job that has just ended referred to; the second
    one lets its files go."""
    for i in range(rounds):
        if i:
            time.sleep(1)
        gc.collect()
        spark._jvm.System.gc()


def _libc(call: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), call)(*args)
    except (AttributeError, OSError):  # another C library
        pass


#: What workers keep between batches and tasks of one function (tables, models), and the function that ran last.
CACHES: list[dict] = []
_RUNNING = {"name": ""}


def cache() -> dict:
    """A worker's cache for a function's tasks, emptied when another function's task begins there."""
    CACHES.append({})
    return CACHES[-1]


def _settle(name: str) -> None:
    pa.set_memory_pool(pa.system_memory_pool())
    _libc("mallopt", -3, 1 << 20)  # M_MMAP_THRESHOLD
    if _RUNNING["name"] != name:
        _RUNNING["name"] = name
        for kept in [*CACHES, _POWERS]:
            kept.clear()
        _libc("malloc_trim", 0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives its worker's free memory back to the system: arrays of a megabyte and more when
    they are freed, the rest when it ends, and what other functions kept there. Workers live on for later tasks and
    stages, and what they hold counts against the executor."""
    name = f"{run.__module__}.{run.__qualname__}"

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settle(name)
        yield from run(batches)
        _libc("malloc_trim", 0)

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out, else spread evenly."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column end to end, and the n + 1 bounds; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `most` bytes, or one longer text: bounds a worker's memory."""
    column = batch.column(batch.schema.get_field_index(name))
    _, at = text_buffer(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def byte_table(word: bytes | None = None) -> np.ndarray:
    """For each byte its lower-case form (A-Z only), or 0 for a byte that ends words: white space,
    or, with `word` given, each ASCII byte that isn't in it."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    if word is None:
        out[list(SPACES)] = 0
        out[0] = 1
    else:
        for b in range(128):
            if bytes([b]).lower() not in {bytes([c]) for c in word}:
                out[b] = 0
    return out


_P = 0x9E3779B97F4A7C15 | 1
#: The first n bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256


def word_hashes(raw: np.ndarray, at: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and bounds of each text's words (n + 1).

    A word is a longest run of bytes with a non-zero entry in lut within one text. Its bytes go eight at a time through
    a chain of finalisers that begins with its length, all words side by side; a long word's through BLAKE2b."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    low = np.zeros(n + 8, np.uint8)
    low[:n] = lut[raw]
    inside = low[:n] != 0
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:n]
    end = inside
    end[:-1] &= ~inside[1:] | fresh[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    size = last - first + 1
    eight = np.ndarray((n + 1,), "<u8", buffer=low, strides=(1,))
    out = mix(size.astype(np.uint64) * U64(_P))
    here = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(here):
        left = size[here] - done
        part = eight[first[here] + done] & _MASKS[np.minimum(left, 8)]
        out[here] = mix((out[here] ^ mix(part + U64(_P))) * U64(0xD6E8FEB86659FD93))
        done += 8
        here = here[left > 8]
    for w in np.flatnonzero(size > LONG_WORD):
        out[w] = np.frombuffer(hashlib.blake2b(low[first[w] : last[w] + 1].tobytes(), digest_size=8).digest(), "<u8")[0]
    return out, np.searchsorted(first, at)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles of each text, and their bounds; a text of 1 to k - 1 words has one, of all of them."""
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    first = bounds[doc] + (np.arange(out_at[-1]) - out_at[doc])
    length = np.minimum(counts, k)[doc]
    h = length.astype(np.uint64)
    for j in range(k):
        here = np.minimum(first + j, max(len(words) - 1, 0))
        nxt = mix(h * U64(0xD6E8FEB86659FD93) + words[here]) if len(words) else h
        h = np.where(j < length, nxt, h)
    return h, out_at


def distinct_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and their bounds."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(at)))


def held_out(id_column, modulus: int, rest: int):
    """crc32 of the id as text, modulo: the fold rule of the learned operators. False for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def row_name(*columns: str):
    """A 64-bit name of a row by some of its columns (id and text): never null, and equal where they all are."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


#: Ids up to which a table of them is broadcast; beyond, rows are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """rows whose id isn't in ids (one column); a null id stays. Texts stay where they are while ids fit a broadcast."""
    gone = ids.toDF("gone__").where("gone__ IS NOT NULL").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, rows[id_col] == gone["gone__"], "left_anti")
