"""Trial records, one row a session and model, and what reports read from them.

A record holds the ranks that each condition gives the target (null: no valid rank), how many members were tried and
broke, how much the valid ones agree, and the failure where too few are valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import hit_at, ndcg_at, order_hash, reciprocal_rank
from . import ensemble as en

LEAST_VALID = 2
CONDITIONS = {"single_prompt_baseline": "single", "naive_mean_ensemble": "naive_mean", "reliability_weighted": "reliability_weighted", "long_tail_weighted": "long_tail_weighted"}
#: The comparisons of the ensemble report.
COMPARISONS = [
    ("reliability_weighted", "single_prompt_baseline"), ("reliability_weighted", "naive_mean_ensemble"), ("naive_mean_ensemble", "single_prompt_baseline"),
    ("long_tail_weighted", "single_prompt_baseline"), ("long_tail_weighted", "reliability_weighted"), ("reliability_weighted", "random_baseline"), ("reliability_weighted", "popularity_baseline"),
]


def lengths(sessions: DataFrame) -> DataFrame:
    """session_id, length and the bounds over all sessions of the file."""
    bounds = sessions.agg(F.min(F.size("prefix")).alias("least"), F.max(F.size("prefix")).alias("most"))
    return sessions.select("session_id", F.size("prefix").alias("length")).join(F.broadcast(bounds))  # one row


def recorded(answers: DataFrame, sessions: DataFrame, members: list[str], model: str, least_valid: int = LEAST_VALID) -> DataFrame:
    """Records of one model. answers: rows of members that parsed; sessions: session_id, split, prefix, target, among
    which those without any answer have a record too. The first member is the single-prompt baseline."""
    own = en.ranks(answers, "member").where("item_id = target")
    by = own.groupBy("session_id").agg(F.count("*").alias("valid"), F.max(F.when(F.col("member") == members[0], F.col("rank"))).alias("single"))
    rows = en.combined(answers, lengths(sessions), members[0], least_valid)
    place = F.row_number().over(Window.partitionBy("session_id", "method").orderBy(F.desc("score"), "position"))
    methods = [v for v in CONDITIONS.values() if v != "single"]
    ranked = rows.withColumn("rank", place).where("item_id = target").groupBy("session_id").agg(*[F.max(F.when(F.col("method") == m, F.col("rank"))).alias(m) for m in methods])
    drift = en.agreement(answers).select("session_id", "mean_tau", F.col("jaccard_5").alias("mean_jaccard_5"))
    out = sessions.select("session_id", "split", "target", F.size("prefix").alias("length")).join(by, "session_id", "left").join(ranked, "session_id", "left").join(drift, "session_id", "left")
    valid = F.coalesce("valid", F.lit(0))
    failure = F.when(valid < least_valid, F.concat(F.lit("only "), valid.cast("string"), F.lit(f" of {least_valid} members needed gave a valid answer")))
    return out.select("session_id", F.lit(model).alias("model"), "split", "target", "length", F.lit(len(members)).alias("attempted"), (F.lit(len(members)) - valid).cast("int").alias("broken"), "single", *methods, "mean_tau", "mean_jaccard_5", failure.alias("failure_reason"))


def single_model(records: DataFrame) -> str:
    """The records' model; fails on several or none."""
    names = [r[0] for r in records.select("model").distinct().limit(3).collect()]
    if len(names) != 1 or names[0] is None:
        raise ValueError("the records must be of one model")
    return names[0]


def unique_sessions(records: DataFrame) -> DataFrame:
    """Fails on a session that has two records or none of the two names (session_id, trial_id)."""
    key = F.coalesce("session_id", "trial_id") if "trial_id" in records.columns else F.col("session_id")
    bad = records.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1 OR k IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"a session without a name, or with two records: {bad[0]['k']}")
    return records


def reference_ranks(pools: DataFrame, popularity: DataFrame, seed: int = 0) -> DataFrame:
    """session_id, random and popular: the target's rank in a seeded order and in order of popularity."""
    rows = pools.select("session_id", "target", "item_id").join(popularity, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("session_id")
    rows = rows.withColumn("random", F.row_number().over(w.orderBy(order_hash(F.lit(seed), F.col("session_id"), F.col("item_id")), "item_id")))
    rows = rows.withColumn("popular", F.row_number().over(w.orderBy(F.desc("n"), "item_id")))
    return rows.where("item_id = target").select("session_id", "random", "popular")


def outcomes(records: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """session_id, model, length, condition and rank (null without a valid one); references adds the two floors."""
    columns = dict(CONDITIONS)
    if references is not None:
        records = records.join(references, "session_id", "left")
        columns |= {"random_baseline": "random", "popularity_baseline": "popular"}
    ranks = F.array(*[F.struct(F.lit(k).alias("condition"), valid_rank(F.col(v)).alias("rank")) for k, v in columns.items()])
    return records.select("session_id", "model", "length", F.inline(ranks))


def valid_rank(rank: Column) -> Column:
    return F.when(rank >= 1, rank)


def condition_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Trials, valid and failed ones, and mean metrics over the valid ones (null without any)."""
    r = F.col("rank")
    means = [F.round(F.avg(hit_at(r, k)), 6).alias(f"hr{k}") for k in (1, 5, 10)] + [F.round(F.avg(ndcg_at(r, k)), 6).alias(f"ndcg{k}") for k in (5, 10)]
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count("rank").alias("valid"), F.count_if(r.isNull()).alias("failed"), *means)


def paired(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """comparison, session_id, a and b: reciprocal ranks of sessions where both conditions have a valid rank."""
    names = sorted({n for p in pairs for n in p})
    wide = rows.groupBy("session_id").agg(*[F.max(F.when(F.col("condition") == n, reciprocal_rank(F.col("rank")))).alias(n) for n in names])
    out = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])
    return wide.select("session_id", F.inline(out)).where("a IS NOT NULL AND b IS NOT NULL").select("comparison", "session_id", "a", "b")


def bucketed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds bucket: short, medium or long by the cuts (one row)."""
    return rows.join(F.broadcast(cuts)).withColumn("bucket", en.history_bucket(F.col("length"), F.col("first"), F.col("second"))).drop("first", "second")


def drift(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.round(F.avg("mean_tau"), 6).alias("mean_tau"), F.round(F.avg("mean_jaccard_5"), 6).alias("mean_jaccard_5"), F.count("mean_tau").alias("sessions"))


# Two models ----------------------------------------------------------------------------------------------------------

TWO = ("single", "reliability_weighted")


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row a session of either model: l and r (structs of the records, null where it has none), paired (both have
    the two ranks that are compared) and complete (no broken answer on either side). Sessions that both have must be of
    the same target and history."""
    for side in (left, right):
        unique_sessions(side)
        single_model(side)
    l, r = (side.select("session_id", F.struct(*side.columns).alias(name)) for side, name in ((left, "l"), (right, "r")))
    rows = l.join(r, "session_id", "full_outer")
    same = (F.col("l.target") == F.col("r.target")) & (F.col("l.length") == F.col("r.length")) & (F.col("l.attempted") == F.col("r.attempted"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    guard = F.when(both & ~same, F.raise_error(F.concat(F.lit("different data for "), "session_id")).cast("string")).otherwise(F.col("session_id"))
    ok = both & F.col("l.single").isNotNull() & F.col("r.single").isNotNull() & F.col("l.reliability_weighted").isNotNull() & F.col("r.reliability_weighted").isNotNull()
    whole = ok & (F.col("l.broken") == 0) & (F.col("r.broken") == 0) & F.col("l.failure_reason").isNull() & F.col("r.failure_reason").isNull()
    return rows.select(guard.alias("session_id"), "l", "r", F.coalesce(ok, F.lit(False)).alias("paired"), F.coalesce(whole, F.lit(False)).alias("complete"))


def alignment(rows: DataFrame) -> DataFrame:
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return rows.agg(F.count_if(l).alias("left_trials"), F.count_if(r).alias("right_trials"), F.count_if(l & r).alias("matched"), F.count_if(l & ~r).alias("only_left"), F.count_if(r & ~l).alias("only_right"), F.count_if(F.col("paired")).alias("analysis"), F.count_if(F.col("complete")).alias("complete"))


def model_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Of paired sessions: each model's condition summary and its mean gain of the weighted ensemble over one prompt."""
    parts = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(c).alias("condition"), F.col(f"{side}.{c}").alias("rank"), (reciprocal_rank(F.col(f"{side}.reliability_weighted")) - reciprocal_rank(F.col(f"{side}.single"))).alias("gain")) for side in ("l", "r") for c in TWO])
    long = rows.where("paired").select("session_id", *by, F.inline(parts))
    gain = long.groupBy(*by, "side", "condition").agg(F.round(F.avg("gain"), 6).alias("gain"))
    return condition_summary(long, *by, "side", "condition").join(gain, [*by, "side", "condition"])


def headline(rows: DataFrame, name: str = "") -> DataFrame:
    """Pairs of the three headline comparisons: gains, weighted ensembles, and left's ensemble against right's one prompt."""
    rr = lambda c: reciprocal_rank(F.col(c))
    l, r, s = rr("l.reliability_weighted"), rr("r.reliability_weighted"), rr("r.single")
    out = {"rwra_gain": (l - rr("l.single"), r - s), "rwra": (l, r), "left_rwra_vs_right_single": (l, s)}
    prefix = F.concat(F.col(name), F.lit(":")) if name else F.lit("")
    return rows.select("session_id", F.inline(F.array(*[F.struct(F.concat(prefix, F.lit(k)).alias("comparison"), a.alias("a"), b.alias("b")) for k, (a, b) in out.items()])))


def other_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of agreement and of the share of broken answers, over all matched sessions that have both."""
    both = rows.where("l IS NOT NULL AND r IS NOT NULL")
    share = lambda side: F.col(f"{side}.broken") / F.nullif(F.col(f"{side}.attempted"), F.lit(0))
    parts = F.array(F.struct(F.lit("drift").alias("comparison"), finite(F.col("l.mean_tau")).alias("a"), finite(F.col("r.mean_tau")).alias("b")), F.struct(F.lit("broken_answers").alias("comparison"), share("l").alias("a"), share("r").alias("b")))
    return both.select("session_id", F.inline(parts)).where("a IS NOT NULL AND b IS NOT NULL")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def broken_answers(rows: DataFrame) -> DataFrame:
    """Of matched sessions: side, broken, attempted and their ratio."""
    both = rows.where("l IS NOT NULL AND r IS NOT NULL")
    long = both.select(F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.broken").alias("broken"), F.col(f"{s}.attempted").alias("attempted")) for s in ("l", "r")])))
    return long.groupBy("side").agg(F.sum("broken").alias("broken"), F.sum("attempted").alias("attempted"), F.round(F.sum("broken") / F.nullif(F.sum("attempted"), F.lit(0)), 6).alias("rate"))
