"""Ensembles of members' scores: agreement, weights, calibration, blends.

Answers are long: session_id, split, target, item_id, position, member, slot, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import long_tail_weight
from .sessions import exploded


def ranks(answers: DataFrame, *by: str) -> DataFrame:
    """rank by score, then pool position, within session and `by`."""
    return answers.withColumn("rank", F.row_number().over(Window.partitionBy("session_id", *by).orderBy(F.desc("score"), "position")))


def kendall(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """tau-b between each two members of each session (`by`): with a, b (a < b) and tau; 0 where undefined.

    A member's values become one array, in order of the items, and that the signs of its pairs; a session's members
    then meet in one row, so no pair of items is ever a row."""
    keys = ["session_id", *by]
    values = rows.groupBy(*keys, "member").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", F.col(value).alias("v")))), lambda x: x["v"]).alias("v"))
    signs = F.flatten(F.transform("v", lambda x, i: F.transform(F.slice(F.col("v"), i + 2, F.greatest(F.size("v") - i - 1, F.lit(0))), lambda y: F.signum((x - y).cast("double")).cast("int"))))
    met = values.select(*keys, "member", signs.alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("member", "s"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice(F.col("m"), i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), lambda y: F.struct(x["member"].alias("a"), y["member"].alias("b"), F.zip_with(x["s"], y["s"], lambda p, q: p * q).alias("both"), x["s"].alias("sa"), y["s"].alias("sb")))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    untied = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + F.abs(x))
    rows = met.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.a", "p.b", total(F.col("p.both")).cast("double").alias("t"), untied(F.col("p.sa")).cast("double").alias("na"), untied(F.col("p.sb")).cast("double").alias("nb"))
    return rows.select(*keys, "a", "b", F.round(F.coalesce(F.col("t") / F.nullif(F.sqrt(F.col("na") * F.col("nb")), F.lit(0.0)), F.lit(0.0)), 9).alias("tau"))


def jaccard_at(ranked: DataFrame, k: int) -> DataFrame:
    """a, b and the Jaccard of two members' first k items."""
    top = ranked.where(F.col("rank") <= k).groupBy("session_id", "member").agg(F.collect_set("item_id").alias("top"))
    a, b = top.select("session_id", F.col("member").alias("a"), F.col("top").alias("ta")), top.select("session_id", F.col("member").alias("b"), F.col("top").alias("tb"))
    return a.join(b, "session_id").where("a < b").select("session_id", "a", "b", F.round(F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb")), 9).alias("jaccard"))


def agreement(answers: DataFrame) -> DataFrame:
    """Mean tau of ranks and mean Jaccard at 5 and 10 over the members of each session; null with one member."""
    r = ranks(answers, "member")
    out = kendall(r, "rank").groupBy("session_id").agg(F.round(F.avg("tau"), 6).alias("mean_tau"))
    for k in (5, 10):
        out = out.join(jaccard_at(r, k).groupBy("session_id").agg(F.round(F.avg("jaccard"), 6).alias(f"jaccard_{k}")), "session_id")
    return answers.select("session_id").distinct().join(out, "session_id", "left")


def reliability(answers: DataFrame) -> DataFrame:
    """session_id, member and weight: mean tau with the others plus one, as a share; even where all is 0; 1 alone."""
    tau = kendall(ranks(answers, "member"), "rank")
    both = tau.select("session_id", F.col("a").alias("member"), "tau").unionByName(tau.select("session_id", F.col("b").alias("member"), "tau"))
    raw = answers.select("session_id", "member").distinct().join(exploded(both.groupBy("session_id", "member").agg((F.avg("tau") + 1).alias("raw"))), ["session_id", "member"], "left")
    w = Window.partitionBy("session_id")
    total, n = F.sum("raw").over(w), F.count("*").over(w)
    return raw.select("session_id", "member", F.round(F.when(total > 0, F.col("raw") / total).otherwise(1 / n), 6).alias("weight"))


def naive_mean(answers: DataFrame) -> DataFrame:
    return answers.groupBy("session_id", "target", "item_id", "position").agg(F.round(F.avg("score"), 9).alias("score"))


def weighted(answers: DataFrame, weights: DataFrame) -> DataFrame:
    return exploded(answers).join(weights, ["session_id", "member"]).groupBy("session_id", "target", "item_id", "position").agg(F.round(F.sum(F.col("weight") * F.col("score")), 9).alias("score"))


def combined(answers: DataFrame, lengths: DataFrame, first_member: str, least_valid: int = 2) -> DataFrame:
    """Long rows with method naive_mean, reliability_weighted and long_tail_weighted of sessions with enough members.

    lengths: session_id, length, least, most (the shortest and longest history of the whole file). The long-tail blend
    needs the first member's answer."""
    n = answers.groupBy("session_id").agg(F.count_distinct("member").alias("n")).where(F.col("n") >= least_valid).select("session_id")
    own = answers.join(n, "session_id", "left_semi")
    rwra = weighted(own, reliability(own))
    base = own.where(F.col("member") == first_member).select("session_id", "item_id", F.col("score").alias("base"))
    w = long_tail_weight(F.col("length"), F.col("least"), F.col("most"))
    tail = rwra.join(exploded(base), ["session_id", "item_id"]).join(lengths.withColumn("w", w), "session_id")
    tail = tail.select("session_id", "target", "item_id", "position", F.round(F.col("w") * F.col("score") + (1 - F.col("w")) * F.col("base"), 9).alias("score"))
    out = None
    for name, df in (("naive_mean", naive_mean(own)), ("reliability_weighted", rwra), ("long_tail_weighted", tail)):
        part = df.withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def zscored(rows: DataFrame, *by: str, value: str = "score") -> DataFrame:
    """z: the score standardised within session and `by` (population deviation); 0 for a constant answer."""
    w = Window.partitionBy("session_id", *by)
    constant = F.max(value).over(w) == F.min(value).over(w)
    return rows.withColumn("z", F.when(constant, 0.0).otherwise(F.round((F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w), 9)))


def slot_priors(z: DataFrame) -> DataFrame:
    """Mean z of each member's slots, over validation sessions."""
    return z.where("split = 'validation'").groupBy("member", "slot").agg(F.round(F.avg("z"), 9).alias("prior"))


def prior_spread(priors: DataFrame) -> DataFrame:
    return priors.groupBy("member").agg(F.round(F.max("prior") - F.min("prior"), 9).alias("spread"))


def calibrated(z: DataFrame, priors: DataFrame) -> DataFrame:
    """z without the slot's prior; a slot that has none loses nothing."""
    return z.join(F.broadcast(priors), ["member", "slot"], "left").withColumn("calibrated", F.col("z") - F.coalesce("prior", F.lit(0.0)))  # members x slots


def mean_over_members(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("session_id", "split", "target", "item_id", "position").agg(F.round(F.avg(value), 9).alias("score"))


def excluded(answers: DataFrame, patterns: list[str]) -> DataFrame:
    """Without the members that a pattern names (variant:context, variant or context); a pattern must match and some
    member must be left."""
    names = [r[0] for r in answers.select("member").distinct().collect()]  # a handful of members
    hit = lambda p: [m for m in names if p in (m, *m.split(":"))]
    gone = {m for p in patterns for m in hit(p)}
    if any(not hit(p) for p in patterns) or not set(names) - gone:
        raise ValueError("a pattern matches no member, or none is left")
    return answers.where(~F.col("member").isin(sorted(gone))) if gone else answers


def complete(answers: DataFrame, members: int) -> DataFrame:
    """Answers of sessions that every member answered."""
    ok = answers.groupBy("session_id").agg(F.count_distinct("member").alias("m")).where(F.col("m") == members).select("session_id")
    return answers.join(ok, "session_id", "left_semi")


def blend_grid(z: DataFrame, rankers: list[str], grid: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0)) -> DataFrame:
    """All weights of the rankers but all zeros, with the mean reciprocal rank of their blend over z's sessions.

    z: session_id, target, item_id, ranker, z. The grid is a literal of len(grid) ** len(rankers) rows; every session's
    pool meets it whole, so this is for validation sessions."""
    spark = z.sparkSession
    wide = z.groupBy("session_id", "target", "item_id").pivot("ranker", rankers).agg(F.first("z"))
    cells = spark.range(len(grid) ** len(rankers)).where("id > 0").select("id", *[F.get(F.array(*map(F.lit, grid)), (F.floor(F.col("id") / len(grid) ** i) % len(grid)).cast("int")).alias(f"w_{r}") for i, r in enumerate(rankers)])
    cells = cells.where(sum((F.col(f"w_{r}") for r in rankers), F.lit(0.0)) > 0)
    pool = wide.groupBy("session_id", "target").agg(F.collect_list(F.struct("item_id", *rankers)).alias("pool"))
    rows = pool.join(F.broadcast(cells))
    blend = F.transform("pool", lambda x: F.struct(x["item_id"].alias("i"), F.round(sum((x[r] * F.col(f"w_{r}") for r in rankers), F.lit(0.0)), 9).alias("s")))
    rows = rows.withColumn("b", blend).withColumn("own", F.get(F.filter("b", lambda x: x["i"] == F.col("target")), F.lit(0))["s"])
    rows = rows.withColumn("greater", F.size(F.filter("b", lambda x: x["s"] > F.col("own")))).withColumn("tied", F.size(F.filter("b", lambda x: x["s"] == F.col("own"))) - 1)
    rr = F.aggregate(F.sequence(F.col("greater") + 1, F.col("greater") + F.col("tied") + 1), F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / r) / (F.col("tied") + 1)
    return rows.groupBy("id", *[f"w_{r}" for r in rankers]).agg(F.round(F.avg(rr), 9).alias("mrr"))


def best_weights(grid: DataFrame, rankers: list[str]) -> DataFrame:
    """The row with the best mean; then with fewer weights above 0, a smaller sum, smaller weights."""
    active = sum((F.when(F.col(f"w_{r}") > 0, 1).otherwise(0) for r in rankers), F.lit(0))
    total = sum((F.col(f"w_{r}") for r in rankers), F.lit(0.0))
    return grid.orderBy(F.desc("mrr"), active, total, *[f"w_{r}" for r in rankers]).limit(1)


def best_llm_weight(means: list[tuple[float, float]]) -> tuple[float, float]:
    """Of (weight, mean) in ascending weight the first that beats all before it by more than 1e-12."""
    best = (0.0, -1.0)
    for weight, mean in means:
        if mean > best[1] + 1e-12:
            best = (weight, mean)
    return best


def blended(z: DataFrame, weights: dict[str, float]) -> DataFrame:
    """session_id, target, item_id and score: the weighted sum of z over the rankers."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return z.where(F.col("ranker").isin(list(weights))).groupBy("session_id", "target", "item_id").agg(F.round(F.sum(F.col("z") * F.element_at(w, F.col("ranker"))), 9).alias("score"))


def history_bucket(length: Column, first: Column, second: Column) -> Column:
    return F.when(length <= first, "short").when(length <= second, "medium").otherwise("long")


def history_cuts(lengths: DataFrame) -> DataFrame:
    """The lengths at places n/3 and 2n/3 (rounded down, from 1) of the sorted lengths: one row.

    Lengths are small numbers, so they are counted by value and the counts summed, instead of sorting sessions."""
    by = lengths.groupBy("length").agg(F.count("*").alias("c"))
    by = by.withColumn("upto", F.sum("c").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)))
    n = by.agg(F.sum("c").alias("n"))
    place = lambda k: F.greatest(F.lit(1), F.floor(F.col("n") * k / 3).cast("long"))
    return by.join(F.broadcast(n)).agg(F.min(F.when(F.col("upto") >= place(1), F.col("length"))).alias("first"), F.min(F.when(F.col("upto") >= place(2), F.col("length"))).alias("second"))
