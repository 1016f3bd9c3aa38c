"""Command line: python -m sessionforge.cli COMMAND ... Each command reads files, runs operators and writes files.

Sessions and pools are JSON lines (pools with their candidates as arrays); answers of a run are a Parquet log, one row a
session, member and item; reports are JSON, one object a row, printed as well."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import context, ensemble, evaluation, pools, popularity, prompts, rankers, records, sessions, trials
from .operators import statistics as st
from .sources import domains
from .sources import tables as src
from .sources.scratch import saved

LEVELS = ["random", "top_popular", "popularity_matched", "attribute_matched", "recency_matched", "retrieval"]


def _spark() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _report(name: str, rows: DataFrame, out: str) -> None:
    """A report's rows (few, by design) as one JSON file."""
    got = [json.loads(r) for r in rows.toJSON().collect()]
    Path(out).mkdir(parents=True, exist_ok=True)
    (Path(out) / f"{name}.json").write_text(json.dumps(got, indent=1, sort_keys=True))
    print(name, json.dumps(got, sort_keys=True))


def _examples(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    return spark.read.schema("user_id long, session_id string, prefix array<long>, target long, target_timestamp long, target_rating double, split string").json(f"{folder}/{prefix}_clean_examples.jsonl")


def _pool(spark: SparkSession, folder: str, prefix: str, level: str) -> DataFrame:
    rows = spark.read.schema("session_id string, split string, target long, candidate_item_ids array<long>, target_retrieved boolean").json(f"{folder}/{prefix}_pool_{level}.jsonl")
    return rows.select("session_id", "split", "target", "target_retrieved", F.lit(level).alias("pool_type"), F.posexplode("candidate_item_ids").alias("position", "item_id"))


def _write_pool(rows: DataFrame, path: str) -> None:
    more = [c for c in ("attribute_matched", "target_retrieved") if c in rows.columns]
    items = F.transform(F.array_sort(F.collect_list(F.struct("position", "item_id"))), lambda x: x["item_id"])
    by = rows.groupBy("session_id", "split", "target", *more).agg(items.alias("candidate_item_ids"))
    src.write_records(by.withColumn("target_position", F.array_position("candidate_item_ids", F.col("target")).cast("int") - 1), path)


def subset(a) -> None:
    _report(f"{a.domain}_subset", domains.build_subset(_spark(), a.domain, a.ratings, a.metadata, a.out, a.user_fraction, a.seed), a.out)


def prepare(a) -> None:
    """Items of raw metadata or of a subset, leave-one-out examples and top-popular pools."""
    spark = _spark()
    if a.domain != "movielens":
        raw = src.read_raw_ratings(spark, domains.ratings_file(a.domain, a.root))
        things = domains.dense_ratings(raw)[2]
        made = domains.game_items(src.wanted_metadata(spark, a.metadata, things), things) if a.domain == "amazon_games" else domains.domain_items(spark, a.metadata, things)
        src.write_records(made, f"{a.out}/{a.domain}_items.jsonl")
    d = domains.load_domain(spark, a.domain, a.root, a.out)
    rows = saved(sessions.leave_one_out(d.ratings, a.min_history_length, a.max_history_length, strict=False).withColumn("split", F.lit("all")))
    pop = popularity.popularity(sessions.training(d.ratings))
    src.write_records(rows, f"{a.out}/{d.prefix}_examples.jsonl")
    _write_pool(pools.top_popular_pools(rows, pop), f"{a.out}/{d.prefix}_pool_top_popular_all.jsonl")
    _report(f"{d.prefix}_summary", d.ratings.agg(F.count("*").alias("ratings"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items")).join(rows.agg(F.count("*").alias("sessions"))), a.out)


def item_popularity(a) -> None:
    ratings = domains.load_ratings(_spark(), a.domain, a.root)
    src.write_popularity(popularity.popularity(sessions.training(ratings)), a.output)


def build_benchmark(a) -> None:
    """Clean examples whose target has a title, pools of all levels, and counts."""
    spark = _spark()
    d = domains.load_domain(spark, a.domain, a.root, a.out)
    items = saved(d.items.join(d.ratings.select("item_id").distinct(), "item_id", "left_semi"))
    train = saved(sessions.training(d.ratings))
    judged = saved(sessions.judged(d.ratings, positive=a.positive_threshold))
    clean = judged.where("drop_reason IS NULL").join(items.select(F.col("item_id").alias("target")), "target", "left_semi").withColumn("split", sessions.split_of(F.col("session_id"), a.validation_fraction, a.seed))
    clean = saved(clean.select("user_id", "session_id", "prefix", "target", "target_timestamp", "target_rating", "split"))
    src.write_records(clean, f"{a.out}/{d.prefix}_clean_examples.jsonl")
    pop = saved(popularity.popularity(train))
    made = {
        "random": pools.random_pools(clean, items, a.pool_size, a.seed), "top_popular": pools.top_popular_pools(clean, pop, a.pool_size),
        "popularity_matched": pools.popularity_matched_pools(clean, pop, items, a.pool_size, a.seed), "attribute_matched": pools.attribute_matched_pools(clean, pop, items, a.pool_size, a.seed),
        "recency_matched": pools.recency_matched_pools(clean, pop, popularity.first_seen(train), items, a.pool_size, a.seed),
        "retrieval": pools.retrieval_pools(clean, rankers.retrieved(clean, train, pop, items, a.pool_size), a.pool_size, a.seed),
    }
    for level, rows in made.items():
        _write_pool(rows, f"{a.out}/{d.prefix}_pool_{level}.jsonl")
    _report(f"{d.prefix}_drops", judged.groupBy(F.coalesce("drop_reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("n")), a.out)
    _report(f"{d.prefix}_splits", clean.groupBy("split").agg(F.count("*").alias("n")), a.out)


def check_benchmark(a) -> None:
    """Rankers' metrics on each level's pools, end to end for retrieval, and which shortcuts work."""
    spark = _spark()
    d = domains.load_domain(spark, a.domain, a.root, a.processed)
    train, clean = saved(sessions.training(d.ratings)), _examples(spark, a.processed, d.prefix).where(F.col("split") == a.split)
    pop = saved(popularity.popularity(train))
    for level in LEVELS:
        own = _pool(spark, a.processed, d.prefix, level).where(F.col("split") == a.split)
        own = saved(own.join(F.broadcast(trials.sampled(own, a.max_sessions, a.seed).select("session_id")), "session_id", "left_semi"))  # a sample of bounded size
        rr = saved(rankers.session_metrics(rankers.all_rankers(own, clean, train, pop, d.items), own.select("session_id", "target").distinct(), "ranker"))
        _report(f"check_{d.prefix}_{level}", rankers.method_means(rr, "ranker"), a.out)
        _report(f"check_{d.prefix}_{level}_targets", st.uniform_quintiles(pools.midranks(own, pop), "pool_type"), a.out)
        pairs = rr.where(F.col("ranker").isin("popularity", "inverse_popularity", "newest_first")).select(F.col("ranker").alias("comparison"), "session_id", F.col("rr").alias("a"), F.lit(0.0).alias("b"))
        size = own.groupBy("session_id").count().agg(F.max("count")).first()[0] or 1
        chance = sum(1 / k for k in range(1, size + 1)) / size
        _report(f"check_{d.prefix}_{level}_shortcuts", st.paired_tests(pairs).select("comparison", "mean_a", "low", "high", st.shortcut(F.col("low"), F.col("high"), F.lit(chance)).alias("shortcut")), a.out)


def run(a) -> None:
    """A run of all members over the sessions of one level, by the stub model: prompts, answers, the strict reader, the log."""
    spark = _spark()
    d = domains.load_domain(spark, a.domain, a.root, a.processed)
    members = domains.parsed_members(a.member, list(prompts.INSTRUCTIONS), list(prompts.CONTEXTS))
    own = _pool(spark, a.processed, d.prefix, a.level)
    if a.level == "retrieval":
        own = pools.found_only(own)
    if a.sample_size:
        own = own.join(F.broadcast(trials.sampled(own, a.sample_size, a.seed).select("session_id")), "session_id", "left_semi")  # a sample of bounded size
    shown = saved(trials.presented(own.drop("target_retrieved"), members, a.seed))
    clean = _examples(spark, a.processed, d.prefix)
    train = sessions.training(d.ratings)
    features = None
    for member in members:
        variant, name = member.split(":")
        order = shown.where(F.col("member") == member).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "item_id"))), lambda x: x["item_id"]).alias("candidates"))
        asked = saved(clean.join(order, "session_id").select("session_id", "user_id", "prefix", "candidates"))
        fields = None
        if name in prompts.FIELD_CONTEXTS:
            features = features or saved(context.item_features(train, popularity.popularity(train), d.items))
            fields = context.fields(name, asked, features, train)
        src.write_records(prompts.prompts(asked, d.items, [variant], name, d.noun, fields), f"{a.out}/prompts_{domains.slug(member)}.jsonl")
    answers = trials.stub_scores(shown, F.count("*").over(_by_trial()))
    read = trials.parsed(trials.responses(answers)).where("parse_error IS NULL").select("session_id", "member")
    log = answers.join(read, ["session_id", "member"], "left_semi").withColumn("model", F.lit(a.model)).withColumn("trial_id", trials.trial_id(F.col("session_id"), F.col("member")))
    src.append_trials(log, f"{a.out}/answers")


def _by_trial():
    from pyspark.sql import Window

    return Window.partitionBy("session_id", "member")


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/answers")


def _records(spark: SparkSession, folder: str, processed: str, prefix: str) -> DataFrame:
    own = _answers(spark, folder)
    model = records.single_model(own)
    members = sorted(r[0] for r in own.select("member").distinct().collect())  # a handful
    ran = _examples(spark, processed, prefix).join(own.select("session_id").distinct(), "session_id", "left_semi")
    return saved(records.recorded(own.drop("model", "trial_id"), ran, members, model))


def evaluate_baseline(a) -> None:
    own = ensemble.ranks(_answers(_spark(), a.trials), "member").where("item_id = target")
    _report("baseline", records.condition_summary(own.select("member", "rank"), "member"), a.out)


def evaluate_ensemble(a) -> None:
    spark = _spark()
    rows = _records(spark, a.trials, a.processed, a.prefix)
    floors = None
    if a.popularity_file and not a.skip_reference_baselines:
        floors = records.reference_ranks(_answers(spark, a.trials).select("session_id", "target", "item_id").distinct(), src.read_popularity(spark, a.popularity_file), a.seed)
    out = saved(records.outcomes(rows, floors))
    known = records.COMPARISONS if floors is not None else records.COMPARISONS[:5]
    _report("conditions", records.condition_summary(out, "condition"), a.out)
    _report("strata", records.condition_summary(records.bucketed(out, ensemble.history_cuts(rows.select("length"))), "bucket", "condition"), a.out)
    _report("comparisons", st.paired_tests(records.paired(out, known), n_boot=a.n_boot, seed=a.seed), a.out)
    _report("drift", records.drift(rows, "model"), a.out)


def _complete_answers(a) -> tuple[DataFrame, int]:
    own = _answers(_spark(), a.trials).drop("model", "trial_id")
    own = saved(ensemble.excluded(own, a.exclude_member) if getattr(a, "exclude_member", None) else own)
    return own, own.select("member").distinct().count()


def _families(pairs: DataFrame) -> DataFrame:
    return st.holm(st.paired_tests(pairs).withColumn("family", F.split("comparison", "/")[0]), "p_flip", "family")


def evaluate_debiased(a) -> None:
    own, n = _complete_answers(a)
    targets = own.select("session_id", "target").distinct()
    rr = saved(rankers.session_metrics(evaluation.debiased_scores(own, n, alone=True), targets, "method"))
    members = sorted(r[0] for r in own.select("member").distinct().collect())  # a handful
    families = {"primary": evaluation.PRIMARY, "secondary": evaluation.SECONDARY, "rwra": evaluation.AGAINST_RWRA, "members": [("rwra", f"member:{m}") for m in members]}
    _report("debiased_methods", rankers.method_means(rr, "method"), a.out)
    _report("debiased_comparisons", _families(evaluation.method_pairs(rr, families)), a.out)
    _report("debiased_members", evaluation.validation_mrr(own), a.out)
    _report("debiased_slot_priors", ensemble.prior_spread(ensemble.slot_priors(ensemble.zscored(own, "member"))), a.out)


def evaluate_hybrid(a) -> None:
    spark = _spark()
    d = domains.load_domain(spark, a.domain, a.root, a.processed)
    own, n = _complete_answers(a)
    own = saved(ensemble.complete(own, n))
    train = saved(sessions.training(d.ratings))
    pool = own.select("session_id", "target", "item_id").distinct()
    scores = rankers.all_rankers(pool, _examples(spark, a.processed, d.prefix), train, popularity.popularity(train), d.items, evaluation.BLENDED)
    z = ensemble.zscored(own, "member")
    llm = ensemble.mean_over_members(ensemble.calibrated(z, ensemble.slot_priors(z)), "calibrated")
    parts = saved(evaluation.components(scores, llm, own.select("session_id", "split", "target").distinct()))
    bases = saved(evaluation.hybrid_bases(parts, evaluation.fitted_weights(parts)))
    weights = evaluation.fitted_llm_weights(evaluation.llm_grid(bases, parts))
    rr = saved(rankers.session_metrics(evaluation.hybrid_scores(parts, bases, weights), own.select("session_id", "target").distinct(), "method"))
    _report("hybrid_methods", rankers.method_means(rr, "method"), a.out)
    _report("hybrid_comparisons", _families(evaluation.method_pairs(rr, evaluation.HYBRID_FAMILIES)), a.out)


def compare_models(a) -> None:
    spark = _spark()
    rows = saved(records.matched(*[_records(spark, folder, a.processed, a.prefix) for folder in (a.left, a.right)]))
    _report("alignment", records.alignment(rows), a.out)
    _report("summaries", records.model_summary(rows), a.out)
    _report("broken_answers", records.broken_answers(rows), a.out)
    _report("comparisons", st.paired_tests(records.headline(rows.where("paired")).unionByName(records.other_pairs(rows))), a.out)
    _report("comparisons_complete", st.paired_tests(records.headline(rows.where("complete"))), a.out)


def compare_variants(a) -> None:
    """Inputs NAME=PATH of baseline reports: the best variant by metric, and all of them as CSV."""
    spark = _spark()
    parts = [spark.read.option("multiLine", True).json(path).withColumn("variant", F.concat_ws(" ", F.lit(name), "member")) for name, path in domains.parsed_inputs(a.metrics).items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows.select("variant", "total", "valid", "hr1", "hr5", "hr10", "ndcg5", "ndcg10").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.out}/variants.csv")
    _report("best_variants", evaluation.best_variants(rows, ["hr1", "hr5", "hr10", "ndcg5", "ndcg10"]), a.out)


def compare_context_title(a) -> None:
    own, n = _complete_answers(a)
    title = own.where(F.col("member") == a.title_member)
    other = own.where(F.col("member") != a.title_member).join(title.select("session_id").distinct(), "session_id", "left_semi")
    rr = saved(rankers.session_metrics(evaluation.context_scores(title, other, n - 1), own.select("session_id", "target").distinct(), "method"))
    contexts = sorted(r[0] for r in other.select("member").distinct().collect())  # a handful
    _report("context_methods", rankers.method_means(rr, "method"), a.out)
    _report("context_comparisons", _families(evaluation.method_pairs(rr, {"contexts": [(c, "title_only") for c in contexts], "ensembles": [("rwra", "title_only"), ("debiased_ensemble", "title_only")]})), a.out)


def compare_grounding(a) -> None:
    spark = _spark()
    d = domains.load_domain(spark, a.domain, a.root, a.processed)
    own, _ = _complete_answers(a)
    train = saved(sessions.training(d.ratings))
    knn = rankers.all_rankers(own.select("session_id", "target", "item_id").distinct(), _examples(spark, a.processed, d.prefix), train, popularity.popularity(train), d.items, ["item_knn"])
    scores, tau, moved = evaluation.grounding(own, a.title_context, a.grounded_context, knn)
    rr = rankers.session_metrics(scores, own.select("session_id", "target").distinct(), "method").select("session_id", "method", "rr")
    rr = saved(rr.unionByName(tau.select("session_id", "method", F.col("tau").alias("rr"))))
    names = sorted({r[0].split(":")[0] for r in rr.where(F.col("method").contains(":")).select("method").distinct().collect()})  # a handful
    families = {"primary": [("agreement_grounded", "agreement_title_only"), ("rwra_grounded", "rwra_title_only"), ("rwra_grounded", "item_knn")], "secondary": [("debiased_grounded", "debiased_title_only"), ("debiased_grounded", "item_knn")], "prompts": [(f"{p}:grounded", f"{p}:title_only") for p in names]}
    _report("grounding_means", rr.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mean")), a.out)
    _report("grounding_comparisons", _families(evaluation.method_pairs(rr, families)), a.out)
    _report("grounding_orders", moved.agg(F.count("*").alias("sessions"), F.count_if("moved").alias("moved")), a.out)


def power_analysis(a) -> None:
    out = records.outcomes(_records(_spark(), a.trials, a.processed, a.prefix))
    pairs = [p for p in records.COMPARISONS[:5] if p != ("long_tail_weighted", "single_prompt_baseline")]
    _report("power", st.power_report(records.paired(out, pairs), a.planned_sessions, a.alpha, a.power), a.out)


def summary(a) -> None:
    """All reports of a folder as one object by name, and the longest prompt of the run in characters."""
    got = {p.stem: json.loads(p.read_text()) for p in sorted(Path(a.out).glob("*.json")) if p.stem != "summary"}
    texts = sorted(Path(a.trials).glob("prompts_*.jsonl"))
    if texts:
        rows = _spark().read.json([str(p) for p in texts])
        got["longest_prompt"] = rows.agg(F.max(F.length("user_message"))).first()[0]
    (Path(a.out) / "summary.json").write_text(json.dumps(got, indent=1, sort_keys=True))


#: Options: name -> (default, type); a default of ... is required, a list may be given again and again.
_DOMAIN = {"domain": (..., str), "root": ("data/raw", str)}
_TRIALS = {"trials": (..., str), "processed": ("data/processed", str), "prefix": (..., str), "out": ("results", str), "seed": (0, int)}
_RUN = _DOMAIN | {"processed": ("data/processed", str), "level": ("popularity_matched", str), "model": ("stub", str), "out": ("results", str), "sample-size": (0, int), "seed": (0, int)}
_WORDINGS = [f"{v}:context_title_v1" for v in prompts.WORDING_SET]
_PREPARE = {"root": ("data/raw", str), "metadata": (None, str), "out": ("data/processed", str), "min-history-length": (3, int), "max-history-length": (None, int)}
_SUBSET = {"ratings": (..., str), "metadata": (..., str), "out": ("data/raw", str), "user-fraction": (None, float), "seed": (0, int)}
COMMANDS = {
    "subset-amazon-movies": (subset, {"domain": ("amazon_movies", str)} | _SUBSET), "subset-amazon-media": (subset, {"domain": (..., str)} | _SUBSET),
    "prepare-movielens": (prepare, {"domain": ("movielens", str)} | _PREPARE), "prepare-amazon-games": (prepare, {"domain": ("amazon_games", str)} | _PREPARE),
    "prepare-amazon-movies": (prepare, {"domain": ("amazon_movies", str)} | _PREPARE), "prepare-amazon-media": (prepare, {"domain": (..., str)} | _PREPARE),
    "build-item-popularity": (item_popularity, _DOMAIN | {"output": (..., str)}),
    "build-benchmark": (build_benchmark, _DOMAIN | {"out": ("data/processed", str), "positive-threshold": (4.0, float), "validation-fraction": (0.3, float), "seed": (0, int), "pool-size": (20, int)}),
    "check-benchmark": (check_benchmark, _DOMAIN | {"processed": ("data/processed", str), "split": ("test", str), "max-sessions": (3000, int), "seed": (0, int), "out": ("results", str)}),
    "run-baseline": (run, _RUN | {"member": (["baseline_scores_v1:context_title_v1"], str)}), "run-ensemble": (run, _RUN | {"member": (_WORDINGS, str)}),
    "evaluate-baseline": (evaluate_baseline, _TRIALS), "evaluate-ensemble": (evaluate_ensemble, _TRIALS | {"n-boot": (2000, int), "popularity-file": (None, str), "skip-reference-baselines": (False, bool)}),
    "evaluate-debiased": (evaluate_debiased, _TRIALS | {"exclude-member": ([], str)}), "evaluate-hybrid": (evaluate_hybrid, _DOMAIN | _TRIALS),
    "compare-models": (compare_models, {"left": (..., str), "right": (..., str), "processed": ("data/processed", str), "prefix": (..., str), "out": ("results", str)}),
    "compare-variants": (compare_variants, {"metrics": ([], str), "out": ("results", str)}),
    "compare-context-title": (compare_context_title, _TRIALS | {"title-member": ("baseline_scores_v1:context_title_v1", str)}),
    "compare-grounding": (compare_grounding, _DOMAIN | _TRIALS | {"title-context": ("context_title_v1", str), "grounded-context": ("context_collab_v2", str)}),
    "power-analysis": (power_analysis, _TRIALS | {"planned-sessions": (3000, int), "alpha": (0.05, float), "power": (0.8, float)}), "summarize": (summary, {"trials": (..., str), "out": ("results", str)}),
}


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="sessionforge", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (call, options) in COMMANDS.items():
        parser = commands.add_parser(name, help=(call.__doc__ or "").split("\n")[0])
        for option, (default, kind) in options.items():
            if kind is bool:
                parser.add_argument(f"--{option}", action="store_true")
            elif isinstance(default, list):
                parser.add_argument(f"--{option}", action="append", type=kind, default=None)
            else:
                parser.add_argument(f"--{option}", type=kind, required=default is ..., default=None if default is ... else default)
    args = top.parse_args(argv)
    call, options = COMMANDS[args.command]
    for option, (default, _) in options.items():
        if isinstance(default, list) and getattr(args, option.replace("-", "_")) is None:
            setattr(args, option.replace("-", "_"), default)
    call(args)


if __name__ == "__main__":
    main()
