"""Ranking metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ndcg_at(rank: Column, k: int) -> Column:
    """1 / log2(rank + 1) up to rank k, else 0; null without a rank."""
    return F.when(rank <= k, 1 / F.log2(rank + 1)).when(rank.isNotNull(), 0.0)


def hit_at(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).when(rank.isNotNull(), 0.0)


def reciprocal_rank(rank: Column) -> Column:
    return 1 / rank


def tie_aware(greater: Column, tied: Column, hr_ks: tuple[int, ...] = (1, 5, 10), ndcg_ks: tuple[int, ...] = (5, 10)) -> dict[str, Column]:
    """Metrics averaged over the ranks greater + 1 .. greater + tied + 1 that a target tied with `tied` others can take."""
    ranks, n = F.sequence(greater + 1, greater + tied + 1), tied + 1

    def mean(value) -> Column:
        return F.round(F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + value(r)) / n, 9)

    out = {"rr": mean(lambda r: F.lit(1.0) / r)}
    for k in hr_ks:
        out[f"hr{k}"] = F.round(F.greatest(F.least(F.lit(k), greater + tied + 1) - greater, F.lit(0)) / n, 9)
    for k in ndcg_ks:
        out[f"ndcg{k}"] = mean(_gain(k))
    return out


def _gain(k: int):
    return lambda r: F.when(r <= k, F.lit(1.0) / F.log2(r + 1)).otherwise(F.lit(0.0))


def expected_random(size: Column, hr_ks: tuple[int, ...] = (1, 5, 10), ndcg_ks: tuple[int, ...] = (5, 10)) -> dict[str, Column]:
    """What a random order of `size` candidates scores on average."""
    out = {f"hr{k}": F.round(F.least(F.lit(k), size) / size, 9) for k in hr_ks}
    for k in ndcg_ks:
        gains = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), size)), F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / F.log2(r + 1))
        out[f"ndcg{k}"] = F.round(gains / size, 9)
    return out


def uniform_hash(*parts: Column) -> Column:
    """A number in [0, 2^32) from the SHA-256 of the parts joined by colons."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("bigint")


def order_hash(*parts: Column) -> Column:
    """A seeded order key: the SHA-256 of the parts joined by colons, as hex."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
