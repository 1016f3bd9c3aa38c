"""Approximate nearest neighbours by largest inner product: an adaptive scan of dimensions within probed lists.

Centroids are learned from a bounded sample; every vector goes to the list of its nearest centroid, and every query
to the lists with the largest inner products. Lists are cut into blocks of bounded size, so a list that holds a third
of all vectors is many tasks. Within a block vectors are rotated at random and held by columns; after each block of
columns a hypothesis test on the partial distance abandons the candidates that can't be among the nearest: with b of
d rotated dimensions read, the distance is estimated as d/b times the partial one, and its relative error exceeds
EPSILON / sqrt(b) but rarely. What is left is measured exactly, in double precision, on the original vectors.

How many lists are probed is set on the sample, by brute force, so that RECALL of the nearest lie in them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

NEAREST = 20
SAMPLE, SAMPLE_QUERIES, MOST_LISTS, ROUNDS = 20_000, 400, 4_096, 8
RECALL, EPSILON, COLUMNS = 0.97, 2.6, 16
#: Vectors and queries that meet in one task's block at most (by hash, so about).
BLOCK_VECTORS, BLOCK_QUERIES = 4_096, 1_024
ROWS = "query_id long, vec_id long, score double"


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same d."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = assign(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def probes_needed(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """Lists to probe so that RECALL of the k nearest in the sample lie in them."""
    q = np.random.default_rng(8).choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)
    own = assign(x, c)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[q] @ c.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)) - 1)]) + 1


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), d)


def floors(ids: np.ndarray, q: np.ndarray, use: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th largest inner product with the sample's vectors in the lists it probes (use), own rows
    left out: its k nearest there reach that at least. Minus infinity where there are fewer."""
    out = np.full(len(q), -np.inf)
    if len(sample) > k:
        for i in range(0, len(q), 128):
            near = q[i : i + 128] @ sample.T
            near[(ids[i : i + 128, None] == sample_ids[None, :]) | ~use[i : i + 128][:, lists]] = -np.inf
            out[i : i + 128] = np.partition(near, len(sample) - k, axis=1)[:, len(sample) - k]
    return out


def scan(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, tau: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k nearest in one block: (query_id, vec_id, score), own row left out, ties to the smaller id. tau: what
    a candidate of each query has to reach."""
    d = x.shape[1]
    turn = rotation(d)
    xr, qr = np.ascontiguousarray((x @ turn).T), q @ turn
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    limit = qq[:, None] + xx[None, :] - 2 * tau[:, None]
    limit += 1e-6 * (qq[:, None] + xx[None, :])  # floors are of vectors in single precision
    b = min(COLUMNS, d)
    part = (qr[:, :b] ** 2).sum(axis=1)[:, None] + (xr[:b] ** 2).sum(axis=0)[None, :] - 2 * (qr[:, :b] @ xr[:b])
    qi, xi = np.nonzero(part * (d / b) <= limit * (1 + EPSILON / math.sqrt(b)) ** 2)
    partial = part[qi, xi]
    while b < d:
        e = min(b + COLUMNS, d)
        diff = qr[qi, b:e] - xr[b:e].T[xi]
        partial = partial + (diff * diff).sum(axis=1)
        b = e
        slack = (1 + EPSILON / math.sqrt(b)) ** 2 if b < d else 1 + 1e-9
        stay = partial * (d / b) <= limit[qi, xi] * slack
        qi, xi, partial = qi[stay], xi[stay], partial[stay]
    other = query_ids[qi] != ids[xi]
    qi, xi = qi[other], xi[other]
    score = (x[xi] * q[qi]).sum(axis=1)
    order = np.lexsort((ids[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    first = np.searchsorted(qi, np.arange(len(q)))
    keep = np.arange(len(qi)) - first[qi] < k
    return query_ids[qi[keep]], ids[xi[keep]], score[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and embedding (double) of the vectors that take part: ids and components not null, all finite, not all
    zero, and as long as most vectors are (the shorter length on a tie)."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda v: v != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (size["d"] if size else -1))


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product found for each query row.

    is_query is a condition on vec_id. A query's own row is none of its candidates; rows that repeat an id count as
    that one id's. With no usable vectors there are no rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = F.xxhash64("vec_id", F.lit(7)).cast("double") / 2.0**64 + 0.5
    got = rows.where(order < min(1.0, SAMPLE / n)).select("vec_id", F.col("embedding").cast("array<float>")).toArrow()  # SAMPLE rows are expected
    if got.num_rows < min(n, 100):
        got = rows.orderBy(order, "vec_id").select("vec_id", F.col("embedding").cast("array<float>")).limit(100).toArrow()
    d = len(got.column(1)[0])
    by_id = np.argsort(got.column(0).to_numpy(), kind="stable")
    sample_ids, sample = got.column(0).to_numpy()[by_id], _matrix(got.column(1), d)[by_id]
    lists = max(1, min(MOST_LISTS, round(math.sqrt(n)), len(sample)))
    c = centroids(sample, lists)
    probes = probes_needed(sample, c, k)
    sent = spark.sparkContext.broadcast((c, sample_ids, sample.astype(np.float32), assign(sample, c)))  # of bounded size

    def to_list(batches):
        for batch in batches:
            own = assign(_matrix(batch.column(1), d), sent.value[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], ["vec_id", "embedding", "list"])

    placed = rows.mapInArrow(to_list, "vec_id long, embedding array<double>, list int")
    counts = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    size = np.array([counts.get(i, 0) for i in range(lists)])
    enough = 4 * k

    def to_probes(batches):
        for batch in batches:
            q = _matrix(batch.column(1), d)
            best = np.argsort(-(q @ sent.value[0].T), axis=1, kind="stable")
            held = np.cumsum(size[best], axis=1) - size[best]  # vectors in the lists before
            use = ((np.arange(lists) < probes) | (held < enough)) & (size[best] > 0)
            probed = np.zeros((len(q), lists), bool)
            np.put_along_axis(probed, best, use, axis=1)
            tau = floors(batch.column(0).to_numpy(), q.astype(np.float32), probed, *sent.value[1:], k)
            qi, at = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(qi)), batch.column(1).take(pa.array(qi)), pa.array(best[qi, at].astype(np.int32)), pa.array(tau[qi].astype(np.float64))], ["vec_id", "embedding", "list", "tau"])

    asked = saved(rows.where(is_query).mapInArrow(to_probes, "vec_id long, embedding array<double>, list int, tau double"))
    probed = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(i, max(1, math.ceil(counts.get(i, 0) / BLOCK_VECTORS)), max(1, math.ceil(probed.get(i, 0) / BLOCK_QUERIES))) for i in range(lists) if probed.get(i)], "list int, v int, w int")

    def dealt(df: DataFrame, own: str, other: str, salt: int, *more: str) -> DataFrame:
        """Each row to one block of its own kind and to all blocks of the other kind."""
        cut = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(own)).cast("int")
        df = df.join(F.broadcast(parts), "list").withColumn("mine", cut)
        return df.select("vec_id", "embedding", *more, "list", "mine", F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))

    left = dealt(placed, "v", "w", 1).select("list", F.col("mine").alias("v"), F.col("theirs").alias("w"), "vec_id", "embedding")
    right = dealt(asked, "w", "v", 2, "tau").select("list", F.col("theirs").alias("v"), F.col("mine").alias("w"), "vec_id", "embedding", "tau")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x = a.column("vec_id").to_numpy(), _matrix(a.column("embedding"), d)
        out = [scan(ids, x, b.column("vec_id").to_numpy()[i : i + 256], _matrix(b.column("embedding").slice(i, 256), d), b.column("tau").to_numpy()[i : i + 256], k) for i in range(0, b.num_rows, 256)]
        return pa.table({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    keys = ["list", "v", "w"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, ROWS)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
