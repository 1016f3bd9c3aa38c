"""Evaluation of members' answers: calibrated ensembles, blends with rankers, and contexts against one another.

Methods' scores are long (session_id, method, item_id, score); reciprocal ranks (session_id, method, rr, ...) come from
them by session_metrics. Everything fitted (priors, preselected member, weights) sees validation sessions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import tie_aware
from ..sources.scratch import saved
from . import ensemble as en
from .popularity import quantiles, tertile
from .rankers import session_metrics
from .sessions import exploded

BLENDED = ["item_knn", "sequential_transitions", "genre_overlap", "title_overlap", "newest_first"]
GRID = (0.0, 0.25, 0.5, 1.0)
LLM_GRID = [round(0.1 * i, 1) for i in range(21)]
PRIMARY = [("debiased_ensemble", "single_prompt_preselected"), ("debiased_ensemble", "naive_mean")]
SECONDARY = [("zscore_mean", "naive_mean"), ("naive_mean", "single_prompt_preselected"), ("rwra", "naive_mean")]
#: Answers whose sessions are evaluated in one round.
AT_ONCE = 5_000_000
AGAINST_RWRA = [("rwra", "single_prompt_preselected"), ("rwra", "naive_mean")]


def member_rr(answers: DataFrame) -> DataFrame:
    """session_id, split, member and rr, tie-aware."""
    targets = answers.select("session_id", "split", "target").distinct()
    return session_metrics(answers.select("session_id", "member", "item_id", "score"), targets, "member").join(targets.select("session_id", "split"), "session_id")


def validation_mrr(answers: DataFrame) -> DataFrame:
    return member_rr(answers.where("split = 'validation'")).groupBy("member").agg(F.round(F.avg("rr"), 9).alias("mrr"))


def preselected(answers: DataFrame) -> DataFrame:
    """member: the best one on validation sessions, of equal ones the last by name. One row."""
    return validation_mrr(answers).agg(F.max_by("member", F.struct("mrr", "member")).alias("member"))


def complete_test(answers: DataFrame, members: int) -> DataFrame:
    """Answers of test sessions that all members answered. Fails without validation or test sessions."""
    splits = {r[0] for r in answers.select("split").distinct().collect()}  # two values
    if not {"validation", "test"} <= splits:
        raise ValueError("both validation and test sessions are needed")
    return en.complete(answers.where("split = 'test'"), members)


def _mean(rows: DataFrame, value: str, method: str) -> DataFrame:
    return rows.groupBy("session_id", "item_id").agg(F.round(F.avg(value), 9).alias("score")).select("session_id", F.lit(method).alias("method"), "item_id", "score")


def debiased_scores(answers: DataFrame, members: int, alone: bool = False) -> DataFrame:
    """Scores of the five methods on complete test sessions; alone adds each member as member:<name>."""
    own = complete_test(answers, members)
    z = en.zscored(answers, "member")
    priors = en.slot_priors(z)
    test = z.join(own.select("session_id").distinct(), "session_id", "left_semi")
    best = own.join(F.broadcast(preselected(answers)), "member", "left_semi").select("session_id", F.lit("single_prompt_preselected").alias("method"), "item_id", "score")  # one row
    weights = en.reliability(own)
    rwra = exploded(own).join(weights, ["session_id", "member"]).groupBy("session_id", "item_id").agg(F.round(F.sum(F.col("weight") * F.col("score")), 9).alias("score")).select("session_id", F.lit("rwra").alias("method"), "item_id", "score")
    out = best
    for part in (_mean(own, "score", "naive_mean"), _mean(test, "z", "zscore_mean"), _mean(en.calibrated(test, priors), "calibrated", "debiased_ensemble"), rwra):
        out = out.unionByName(part)
    if alone:
        out = out.unionByName(own.select("session_id", F.concat(F.lit("member:"), "member").alias("method"), "item_id", "score"))
    return out


def method_pairs(rr: DataFrame, families: dict[str, list[tuple[str, str]]], value: str = "rr") -> DataFrame:
    """comparison (family/a_vs_b), session_id, a and b of sessions that have both methods."""
    names = sorted({n for pairs in families.values() for p in pairs for n in p})
    wide = rr.where(F.col("method").isin(names)).groupBy("session_id").agg(*[F.max(F.when(F.col("method") == n, F.col(value))).alias(f"m{i}") for i, n in enumerate(names)])
    at = {n: f"m{i}" for i, n in enumerate(names)}
    rows = F.array(*[F.struct(F.lit(f"{f}/{a}_vs_{b}").alias("comparison"), F.col(at[a]).alias("a"), F.col(at[b]).alias("b")) for f, pairs in families.items() for a, b in pairs])
    return wide.select("session_id", F.inline(rows)).where("a IS NOT NULL AND b IS NOT NULL")


def agreement_on_scores(answers: DataFrame) -> DataFrame:
    """session_id and tau: mean tau-b of the members' raw scores, whose ties no position breaks."""
    return en.kendall(answers, "score").groupBy("session_id").agg(F.round(F.avg("tau"), 9).alias("tau"))


def rarity(counts: DataFrame) -> DataFrame:
    """session_id, n -> stratum by tertiles (interpolated) of the targets' counts."""
    return counts.select("session_id", tertile(F.col("n"), quantiles(counts, "n", 1 / 3, 2 / 3), ("rare", "moderate", "popular")).alias("stratum"))


def end_to_end(means: DataFrame, recall: DataFrame, metrics: list[str]) -> DataFrame:
    """Each mean times the retriever's recall (one row)."""
    return means.join(F.broadcast(recall)).select("method", *[F.round(F.col(m) * F.col("recall"), 6).alias(m) for m in metrics])


# Blends with rankers -------------------------------------------------------------------------------------------------


def standardised(rows: DataFrame, method: str) -> DataFrame:
    """Rows (session_id, item_id, score) as component `method` with z."""
    return en.zscored(rows, value="score").select("session_id", "item_id", F.lit(method).alias("ranker"), "score", "z")


def components(scores: DataFrame, llm: DataFrame, targets: DataFrame) -> DataFrame:
    """session_id, split, target, item_id, ranker, score, z of the base rankers and of the calibrated ensemble (llm)."""
    both = scores.select("session_id", "item_id", "ranker", "score").unionByName(llm.select("session_id", "item_id", F.lit("llm").alias("ranker"), "score"))
    return en.zscored(both, "ranker").join(targets, "session_id")


def fitted_weights(parts: DataFrame) -> dict[str, float]:
    """The base rankers' weights that do best on validation sessions."""
    grid = en.blend_grid(parts.where(F.col("split") == "validation").where(F.col("ranker").isin(BLENDED)), BLENDED, GRID)
    row = en.best_weights(grid, BLENDED).first()
    return {r: row[f"w_{r}"] for r in BLENDED}


def llm_grid(base: DataFrame, parts: DataFrame) -> DataFrame:
    """method, weight and mrr: of base (session_id, item_id, ranker, z) plus weight times the ensemble, on validation. A
    session's pool meets the weights as one row; its items are never rows of each weight."""
    llm = parts.where("ranker = 'llm' AND split = 'validation'").select("session_id", "target", "item_id", F.col("z").alias("zl"))
    rows = base.select("session_id", "item_id", F.col("ranker").alias("method"), "z").join(exploded(llm), ["session_id", "item_id"])
    rows = rows.groupBy("session_id", "target", "method").agg(F.collect_list(F.struct("item_id", "z", "zl")).alias("pool"))
    blend = F.transform("pool", lambda x: F.struct(x["item_id"].alias("i"), F.round(x["z"] + F.col("weight") * x["zl"], 9).alias("s")))
    rows = rows.withColumn("weight", F.explode(F.array(*map(F.lit, LLM_GRID)))).withColumn("b", blend)
    rows = rows.withColumn("own", F.get(F.filter("b", lambda x: x["i"] == F.col("target")), F.lit(0))["s"])
    rows = rows.withColumn("greater", F.size(F.filter("b", lambda x: x["s"] > F.col("own")))).withColumn("tied", F.size(F.filter("b", lambda x: x["s"] == F.col("own"))) - 1)
    return rows.groupBy("method", "weight").agg(F.round(F.avg(tie_aware(F.col("greater"), F.col("tied"))["rr"]), 9).alias("mrr"))


def fitted_llm_weights(grid: DataFrame) -> dict[str, float]:
    """By method the weight with the best mean; of equal ones the least."""
    rows = {}
    for r in grid.collect():  # a weight for each step of the grid and method
        rows.setdefault(r["method"], []).append((r["weight"], r["mrr"]))
    return {m: en.best_llm_weight(sorted(v))[0] for m, v in rows.items()}


HYBRIDS = {"hybrid": "nonllm_blend", "item_knn+llm": "item_knn", "sequential+llm": "sequential_transitions"}
HYBRID_FAMILIES = {"primary": [("hybrid", "nonllm_blend")], "secondary": [("item_knn+llm", "item_knn"), ("sequential+llm", "sequential_transitions"), ("llm", "nonllm_blend")]}


def hybrid_bases(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The three bases that the ensemble is added to, standardised: the blend, item-KNN and transitions."""
    blend = en.blended(parts, weights).select("session_id", "item_id", "score")
    own = parts.where(F.col("ranker").isin("item_knn", "sequential_transitions")).select("session_id", "item_id", "ranker", "score", "z")
    return standardised(blend, "nonllm_blend").unionByName(own)


def hybrid_scores(parts: DataFrame, bases: DataFrame, llm_weights: dict[str, float]) -> DataFrame:
    """session_id, method, item_id, score on test sessions: rankers, ensemble, blend and the three sums with it."""
    test = parts.where("split = 'test'")
    keys = test.select("session_id").distinct()
    out = test.select("session_id", F.col("ranker").alias("method"), "item_id", "score")
    base = bases.join(keys, "session_id", "left_semi")
    out = out.unionByName(base.where("ranker = 'nonllm_blend'").select("session_id", F.col("ranker").alias("method"), "item_id", "score"))
    llm = test.where("ranker = 'llm'").select("session_id", "item_id", F.col("z").alias("zl"))
    for name, of in HYBRIDS.items():
        rows = base.where(F.col("ranker") == of).join(exploded(llm), ["session_id", "item_id"])
        out = out.unionByName(rows.select("session_id", F.lit(name).alias("method"), "item_id", F.round(F.col("z") + F.lit(llm_weights[of]) * F.col("zl"), 9).alias("score")))
    return out


# Contexts against one another ----------------------------------------------------------------------------------------


def variant_of(member: Column) -> Column:
    return F.split(member, ":")[0]


def context_of(member: Column) -> Column:
    return F.split(member, ":")[1]


def same_candidates(left: DataFrame, right: DataFrame) -> None:
    """Fails where a session of right has no rows in left, or other candidates or another target."""
    pool = lambda df: df.groupBy("session_id", "target").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    bad = pool(right).join(exploded(pool(left)), ["session_id", "target", "items"], "left_anti").limit(1).collect()
    if bad:
        raise ValueError(f"session {bad[0]['session_id']} was scored on different candidates, or in one run alone")


def context_scores(title: DataFrame, contexts: DataFrame, members: int) -> DataFrame:
    """Scores on test sessions that have the title-only answer and all context members': title_only, each context, the
    reliability-weighted and the debiased ensemble of the contexts."""
    same_candidates(title, contexts)
    own = complete_test(contexts, members).join(title.select("session_id").distinct(), "session_id", "left_semi")
    z = en.zscored(contexts, "member")
    test = z.join(own.select("session_id").distinct(), "session_id", "left_semi")
    out = title.join(own.select("session_id").distinct(), "session_id", "left_semi").select("session_id", F.lit("title_only").alias("method"), "item_id", "score")
    out = out.unionByName(own.select("session_id", F.col("member").alias("method"), "item_id", "score"))
    rwra = exploded(own).join(en.reliability(own), ["session_id", "member"]).groupBy("session_id", "item_id").agg(F.round(F.sum(F.col("weight") * F.col("score")), 9).alias("score"))
    out = out.unionByName(rwra.select("session_id", F.lit("rwra").alias("method"), "item_id", "score"))
    return out.unionByName(_mean(en.calibrated(test, en.slot_priors(z)), "calibrated", "debiased_ensemble"))


def runs(answers: DataFrame, title: str, grounded: str) -> DataFrame:
    """Answers of the two contexts with run and prompt."""
    rows = answers.where(context_of(F.col("member")).isin(title, grounded))
    run = F.when(context_of(F.col("member")) == title, "title_only").otherwise("grounded")
    return rows.withColumn("run", run).withColumn("prompt", variant_of(F.col("member")))


def fitted(answers: DataFrame, title: str, grounded: str) -> tuple[list[str], DataFrame]:
    """The prompts that the grounded context has, and the slots' priors."""
    rows = runs(answers, title, grounded)
    prompts = sorted(r[0] for r in rows.where("run = 'grounded'").select("prompt").distinct().collect())  # a handful
    if not prompts:
        raise ValueError(f"no member of context {grounded}")
    validation = rows.where(F.col("prompt").isin(prompts) & (F.col("split") == "validation"))
    return prompts, saved(en.slot_priors(en.zscored(validation, "member")))


def answered(rows: DataFrame, prompts: list[str]) -> DataFrame:
    """Rows of the prompts, of test sessions that every prompt answered in both contexts."""
    own = rows.where(F.col("prompt").isin(prompts) & (F.col("split") == "test"))
    ok = own.groupBy("session_id").agg(F.count_distinct("member").alias("m")).where(F.col("m") == 2 * len(prompts)).select("session_id")
    return own.join(ok, "session_id", "left_semi")


def moved(own: DataFrame) -> DataFrame:
    """session_id and moved: whether a prompt saw its candidates in another order in the two runs."""
    return own.groupBy("session_id", "prompt", "item_id").agg((F.min("slot") != F.max("slot")).alias("m")).groupBy("session_id").agg(F.max("m").alias("moved"))


def grounding(answers: DataFrame, title: str, grounded: str, knn: DataFrame, fit: tuple[list[str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of test sessions that every prompt answered in both contexts: scores by method, agreement by run (session_id,
    method, tau) and whether a prompt saw its candidates in another order in the two runs (session_id, moved).

    fit: what fitted gives for all answers, where these are those of some sessions."""
    prompts, priors = fitted(answers, title, grounded) if fit is None else fit
    own = answered(runs(answers, title, grounded), prompts)
    debiased = en.calibrated(en.zscored(own, "member"), priors)
    keep = lambda df: df.join(own.select("session_id").distinct(), "session_id", "left_semi")
    out = own.select("session_id", F.concat("prompt", F.lit(":"), "run").alias("method"), "item_id", "score").unionByName(keep(knn).select("session_id", F.lit("item_knn").alias("method"), "item_id", "score"))
    mean = debiased.groupBy("session_id", "run", "item_id").agg(F.round(F.avg("calibrated"), 9).alias("score"))
    out = out.unionByName(mean.select("session_id", F.concat(F.lit("debiased_"), "run").alias("method"), "item_id", "score"))
    tau, rwra = None, None
    for r in ("title_only", "grounded"):
        part = own.where(F.col("run") == r)
        w = exploded(part).join(en.reliability(part), ["session_id", "member"]).groupBy("session_id", "item_id").agg(F.round(F.sum(F.col("weight") * F.col("score")), 9).alias("score")).select("session_id", F.lit(f"rwra_{r}").alias("method"), "item_id", "score")
        t = agreement_on_scores(part).select("session_id", F.lit(f"agreement_{r}").alias("method"), "tau")
        tau, rwra = (t, w) if tau is None else (tau.unionByName(t), rwra.unionByName(w))
    return out.unionByName(rwra), tau, moved(own)


def best_variants(summaries: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, best and variants: those with the greatest value, ties kept in order; null values don't count."""
    long = summaries.select("variant", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))).where("value IS NOT NULL")
    best = F.max("value").over(Window.partitionBy("metric"))
    return long.withColumn("best", best).where("value = best").groupBy("metric").agg(F.max("best").alias("best"), F.array_join(F.array_sort(F.collect_list("variant")), ",").alias("variants"))
