"""Queries of the evaluation reports and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import uniform_hash
from ..operators import ensemble as en
from ..operators import evaluation as ev
from ..operators import pools, rankers, records, trials
from ..operators import popularity as pop
from ..operators import statistics as st
from ..sources.scratch import in_rounds
from .oracle import PARTS, means, metrics, order, sql, u
from .registry import RANKER_PAIRS, Bench, query, ranker_pairs

#: The simulated models: the seed of a model's answers, and of how many answers one is broken.
MODELS = {"small": (0, 20), "large": (1, 50)}
N = len(trials.MEMBERS)


class Trials(Bench):
    """Answers and records of the simulated models over the random pools."""

    def parsed(self, model: str) -> DataFrame:
        seed, broken = MODELS[model]

        def build() -> DataFrame:
            rows = trials.hash_scores(trials.presented(self.random(), trials.MEMBERS), seed)
            return rows.where(F.pmod(uniform_hash(F.lit("fail"), F.lit(model), F.col("session_id"), F.col("member")), F.lit(broken)) != 0)

        return self.kept(f"parsed {model}", build)

    def records(self, model: str) -> DataFrame:
        return self.kept(f"records {model}", lambda: records.recorded(self.parsed(model), self.clean, trials.MEMBERS, model))

    def rounds(self) -> int:
        """Rounds of sessions that the small model's answers are evaluated in."""
        return -(-self.parsed("small").count() // ev.AT_ONCE)

    def outcomes(self) -> DataFrame:
        return self.kept("outcomes", lambda: records.outcomes(self.records("small"), records.reference_ranks(self.random(), self.pop)))

    def matched_models(self) -> DataFrame:
        return self.kept("matched models", lambda: records.matched(self.records("small"), self.records("large")))


def _model_sql(m: str) -> dict[str, str]:
    """Common table expressions of a model: answers that parsed, ranks, agreement, weights, methods and records."""
    seed, broken = MODELS[m]
    raw = PARTS["answers"].replace(u("0", "member", "session_id", "item_id"), u(str(seed), "member", "session_id", "item_id"))
    jac = f"""SELECT session_id, round(avg(j), 6) AS j FROM (SELECT x.session_id, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 9) AS j
      FROM top_{m} x JOIN top_{m} y ON x.session_id = y.session_id AND x.member < y.member) GROUP BY ALL"""
    return {
        "pool": "SELECT * FROM rand",
        f"ans_{m}": f"SELECT * FROM ({raw}) WHERE {u(repr('fail'), repr(m), 'session_id', 'member')} % {broken} <> 0",
        f"rk_{m}": f"SELECT *, row_number() OVER (PARTITION BY session_id, member ORDER BY score DESC, position) AS rank FROM ans_{m}",
        f"sgn_{m}": PARTS["sgn"].replace("ranked", f"rk_{m}"),
        f"tau_{m}": PARTS["tau"].replace("sgn", f"sgn_{m}"),
        f"rel_{m}": PARTS["rel"].replace("FROM tau", f"FROM tau_{m}"),
        f"top_{m}": f"SELECT session_id, member, list(item_id) AS t FROM rk_{m} WHERE rank <= 5 GROUP BY ALL",
        f"jac_{m}": jac,
        f"val_{m}": f"SELECT session_id, count(DISTINCT member) AS valid, max(rank) FILTER (item_id = target AND member = '{trials.MEMBERS[0]}') AS single FROM rk_{m} GROUP BY session_id",
        "lens": "SELECT session_id, len(prefix) AS length, min(len(prefix)) OVER () AS least, max(len(prefix)) OVER () AS most FROM clean",
        f"two_{m}": f"SELECT * FROM ans_{m} WHERE session_id IN (SELECT session_id FROM val_{m} WHERE valid >= 2)",
        f"rw_{m}": f"SELECT session_id, target, item_id, position, round(sum(weight * score), 9) AS score FROM two_{m} JOIN rel_{m} USING (session_id, member) GROUP BY ALL",
        f"comb_{m}": f"""SELECT session_id, target, item_id, position, round(avg(score), 9) AS score, 'naive_mean' AS method FROM two_{m} GROUP BY session_id, target, item_id, position
          UNION ALL SELECT *, 'reliability_weighted' FROM rw_{m}
          UNION ALL SELECT r.session_id, r.target, r.item_id, r.position, round(w * r.score + (1 - w) * a.score, 9), 'long_tail_weighted' FROM rw_{m} r JOIN two_{m} a ON a.session_id = r.session_id AND a.item_id = r.item_id AND a.member = '{trials.MEMBERS[0]}'
            JOIN (SELECT session_id, greatest((ln(most + 1) - ln(length + 1)) / nullif(ln(most + 1) - ln(least + 1), 0), 0.3) * 0.7 AS w FROM lens) l ON l.session_id = r.session_id""",
        f"mr_{m}": f"""SELECT session_id, max(rank) FILTER (method = 'naive_mean') AS naive_mean, max(rank) FILTER (method = 'reliability_weighted') AS reliability_weighted, max(rank) FILTER (method = 'long_tail_weighted') AS long_tail_weighted
          FROM (SELECT *, row_number() OVER (PARTITION BY session_id, method ORDER BY score DESC, position) AS rank FROM comb_{m}) WHERE item_id = target GROUP BY session_id""",
        f"mt_{m}": f"SELECT session_id, round(avg(tau), 6) AS mean_tau FROM tau_{m} GROUP BY session_id",
        f"rec_{m}": f"""SELECT c.session_id, '{m}' AS model, c.split, c.target, len(c.prefix) AS length, {N} AS attempted, {N} - coalesce(v.valid, 0) AS broken, v.single, r.naive_mean, r.reliability_weighted, r.long_tail_weighted,
          t.mean_tau, j.j AS mean_jaccard_5, CASE WHEN coalesce(v.valid, 0) < 2 THEN 'only ' || coalesce(v.valid, 0) || ' of 2 members needed gave a valid answer' END AS failure_reason
          FROM clean c LEFT JOIN val_{m} v USING (session_id) LEFT JOIN mr_{m} r USING (session_id) LEFT JOIN mt_{m} t USING (session_id) LEFT JOIN jac_{m} j USING (session_id)""",
    }


_SMALL, _LARGE = _model_sql("small"), _model_sql("large")
_FLOORS = f"""SELECT session_id, rnd, popular FROM (SELECT p.session_id, p.item_id, p.target, row_number() OVER (PARTITION BY session_id ORDER BY {order('0', 'session_id', 'item_id')}, item_id) AS rnd,
  row_number() OVER (PARTITION BY session_id ORDER BY coalesce(n, 0) DESC, item_id) AS popular FROM pool p LEFT JOIN pop USING (item_id)) WHERE item_id = target"""
_LONG = {"single_prompt_baseline": "single", "naive_mean_ensemble": "naive_mean", "reliability_weighted": "reliability_weighted", "long_tail_weighted": "long_tail_weighted", "random_baseline": "rnd", "popularity_baseline": "popular"}
_OUT = _SMALL | {
    "floors": _FLOORS,
    "base_o": "SELECT r.*, f.rnd, f.popular FROM rec_small r LEFT JOIN floors f USING (session_id)",
    "outc": " UNION ALL ".join(f"SELECT session_id, length, '{k}' AS condition, {v} AS rank FROM base_o" for k, v in _LONG.items()),
    "cuts": "SELECT min(length) FILTER (k = greatest(1, n // 3)) AS first, min(length) FILTER (k = greatest(1, 2 * n // 3)) AS second FROM (SELECT length, row_number() OVER (ORDER BY length) AS k, count(*) OVER () AS n FROM rec_small)",
}


def _summary(source: str, by: str) -> str:
    hr = ", ".join(f"round(avg((rank <= {k})::INT), 6) AS hr{k}" for k in (1, 5, 10))
    nd = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) WHEN rank IS NOT NULL THEN 0 END), 6) AS ndcg{k}" for k in (5, 10))
    return f"SELECT {by}, count(*) AS total, count(rank) AS valid, count(*) FILTER (rank IS NULL) AS failed, {hr}, {nd} FROM {source} GROUP BY {by}"


def _hashed(first: int, n: int) -> str:
    """Numbers of draws of each row of `bs`."""
    p = st.PRIME
    return f"""(SELECT comparison, d, i, (x2 * x2 + (i + 1) * 16807) % {p} AS x FROM (SELECT comparison, d, i, (x1 * x1 + x0 + 7) % {p} AS x2 FROM (
      SELECT comparison, d, x0, i, (x0 * 48271 + (i + 1) * 69621) % {p} AS x1 FROM bs, (SELECT unnest(range({first}, {first + n})) AS i))))"""


def _tests(pairs: str) -> dict[str, str]:
    """Common table expressions of the paired tests of `pairs` (comparison, session_id, a, b); the last is `tested`."""
    times = " + ".join(f"(x >= {t})::INT" for t in st.POISSON)
    return {
        "prs": f"SELECT comparison, session_id, a::DOUBLE AS a, b::DOUBLE AS b FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL",
        "bs": f"SELECT comparison, a - b AS d, {u('0', 'session_id')} % {st.PRIME} AS x0 FROM prs",
        "own_t": "SELECT comparison, count(*) AS n, abs(sum(a - b)) AS observed, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean FROM prs GROUP BY comparison",
        "flp": f"SELECT comparison, i, sum(d * (x % 2 * 2 - 1)) AS f FROM {_hashed(0, st.FLIPS)} GROUP BY ALL",
        "pfl": f"SELECT comparison, (count(*) FILTER (abs(f) / n >= observed / n - 1e-12) + 1) / ({st.FLIPS} + 1) AS p_flip FROM flp JOIN own_t USING (comparison) GROUP BY comparison",
        "bot": f"SELECT comparison, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT comparison, i, sum(d * t) / nullif(sum(t), 0) AS m FROM (SELECT comparison, i, d, {times} AS t FROM {_hashed(st.RESAMPLES_FROM, st.BOOTSTRAP)}) GROUP BY ALL) GROUP BY comparison",
        "szs": "SELECT comparison, abs(d) AS size, d FROM (SELECT comparison, round(a - b, 12) AS d FROM prs) WHERE d <> 0",
        "wlx": """SELECT comparison, n, least(w, n * (n + 1) / 2 - w) AS statistic, sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS sd FROM (
          SELECT comparison, sum(c)::DOUBLE AS n, sum(r * plus) AS w, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT comparison, size, count(*) AS c, count(*) FILTER (d > 0) AS plus, min(k) + (count(*) - 1) / 2 AS r
          FROM (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY size) AS k FROM szs) GROUP BY ALL) GROUP BY comparison)""",
        "wlp": """SELECT comparison, statistic, CASE WHEN x = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum([exp(2 * k * ln(2) + (2 * k + 1) * ln(x) + lgamma(k + 1) - lgamma(2 * k + 2)) FOR k IN range(0, 161)])) END AS p_wilcoxon
          FROM (SELECT *, least(abs((statistic - n * (n + 1) / 4) / sd), 8.0) / sqrt(2) AS x FROM wlx)""",
        "tested": """SELECT comparison, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(p_flip, 6) AS p_flip, round(statistic, 6) AS statistic, round(p_wilcoxon, 6) AS p_wilcoxon
          FROM own_t JOIN pfl USING (comparison) JOIN bot USING (comparison) LEFT JOIN wlp USING (comparison)""",
    }


_FAMILY = """SELECT *, max(least(1.0, (m - k + 1) * p_flip)) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING) AS p_holm FROM (
  SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p_flip, comparison) AS k FROM (SELECT split_part(comparison, '/', 1) AS family, * FROM tested))"""
_HOLM = f"SELECT * EXCLUDE (m, k, p_holm), round(p_holm, 6) AS p_holm FROM ({_FAMILY})"


def _families(pairs: DataFrame) -> DataFrame:
    rows = st.paired_tests(pairs).withColumn("family", F.split("comparison", "/")[0])
    return st.holm(rows, "p_flip", "family").withColumn("p_holm", F.round("p_holm", 6))


@query(sql("SELECT *, least(1.0, p_flip) AS p_holm FROM tested", pool="SELECT * FROM match", **_tests(f"SELECT 'item_knn - popularity' AS comparison, session_id, a, b FROM ({RANKER_PAIRS})")))
def paired_tests(spark, sf_dir):
    return st.holm(st.paired_tests(ranker_pairs(spark, sf_dir)), "p_flip")


# The ensemble report -------------------------------------------------------------------------------------------------


@query(sql("SELECT * FROM rec_small", **_SMALL))
def ensemble_records(spark, sf_dir):
    return Trials(spark, sf_dir).records("small")


@query(sql(_summary("outc", "condition"), **_OUT))
def ensemble_conditions(spark, sf_dir):
    return records.condition_summary(Trials(spark, sf_dir).outcomes(), "condition")


@query(sql(_summary("(SELECT o.*, CASE WHEN length <= first THEN 'short' WHEN length <= second THEN 'medium' ELSE 'long' END AS bucket FROM outc o, cuts)", "bucket, condition"), **_OUT))
def ensemble_strata(spark, sf_dir):
    b = Trials(spark, sf_dir)
    return records.condition_summary(records.bucketed(b.outcomes(), en.history_cuts(b.records("small").select("length"))), "bucket", "condition")


_ENSEMBLE_PAIRS = " UNION ALL ".join(f"SELECT '{a}_vs_{b}' AS comparison, session_id, 1 / {_LONG[a]} AS a, 1 / {_LONG[b]} AS b FROM base_o" for a, b in records.COMPARISONS)


@query(sql("SELECT * FROM tested", **_OUT, **_tests(_ENSEMBLE_PAIRS)))
def ensemble_comparisons(spark, sf_dir):
    return st.paired_tests(records.paired(Trials(spark, sf_dir).outcomes(), records.COMPARISONS))


@query(sql("SELECT model, round(avg(mean_tau), 6) AS mean_tau, round(avg(mean_jaccard_5), 6) AS mean_jaccard_5, count(mean_tau) AS sessions FROM rec_small GROUP BY model", **_SMALL))
def ensemble_drift(spark, sf_dir):
    return records.drift(Trials(spark, sf_dir).records("small"), "model")


# Two models ----------------------------------------------------------------------------------------------------------

_TWO = _SMALL | _LARGE | {
    "twin": """SELECT coalesce(l.session_id, r.session_id) AS session_id, l.session_id IS NOT NULL AS has_l, r.session_id IS NOT NULL AS has_r, l.length, l.single AS ls, r.single AS rs, l.reliability_weighted AS lw, r.reliability_weighted AS rw,
      l.mean_tau AS lt, r.mean_tau AS rt, l.broken AS lb, r.broken AS rb, l.attempted AS la, r.attempted AS ra, coalesce(l.single IS NOT NULL AND r.single IS NOT NULL AND l.reliability_weighted IS NOT NULL AND r.reliability_weighted IS NOT NULL, false) AS paired
      FROM rec_small l FULL JOIN rec_large r USING (session_id)""",
    "cuts2": "SELECT min(length) FILTER (k = greatest(1, n // 3)) AS first, min(length) FILTER (k = greatest(1, 2 * n // 3)) AS second FROM (SELECT length, row_number() OVER (ORDER BY length) AS k, count(*) OVER () AS n FROM twin WHERE paired)",
    "grouped": "SELECT b.*, CASE WHEN length <= first THEN 'short' WHEN length <= second THEN 'medium' ELSE 'long' END AS bucket FROM twin b, cuts2 WHERE paired",
}


@query(sql("SELECT count(*) FILTER (has_l) AS left_trials, count(*) FILTER (has_r) AS right_trials, count(*) FILTER (has_l AND has_r) AS matched, count(*) FILTER (has_l AND NOT has_r) AS only_left, count(*) FILTER (has_r AND NOT has_l) AS only_right, count(*) FILTER (paired) AS analysis, count(*) FILTER (paired AND lb = 0 AND rb = 0) AS complete FROM twin", **_TWO))
def model_alignment(spark, sf_dir):
    return records.alignment(Trials(spark, sf_dir).matched_models())


def _sides(source: str, by: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {by}'{s}' AS side, '{c}' AS condition, {s}{k} AS rank, 1 / {s}w - 1 / {s}s AS gain FROM {source}" for s in "lr" for c, k in (("single", "s"), ("reliability_weighted", "w")))


@query(sql(f"SELECT s.*, g.gain FROM ({_summary('(' + _sides('twin WHERE paired') + ')', 'side, condition')}) s JOIN (SELECT side, condition, round(avg(gain), 6) AS gain FROM ({_sides('twin WHERE paired')}) GROUP BY ALL) g USING (side, condition)", **_TWO))
def model_summaries(spark, sf_dir):
    return records.model_summary(Trials(spark, sf_dir).matched_models())


@query(sql(f"SELECT s.*, g.gain FROM ({_summary('(' + _sides('grouped', 'bucket, ') + ')', 'bucket, side, condition')}) s JOIN (SELECT bucket, side, condition, round(avg(gain), 6) AS gain FROM ({_sides('grouped', 'bucket, ')}) GROUP BY ALL) g USING (bucket, side, condition)", **_TWO))
def model_summaries_by_history(spark, sf_dir):
    return records.model_summary(_by_history(Trials(spark, sf_dir)), "bucket")


def _by_history(b: Trials) -> DataFrame:
    rows = b.matched_models().where("paired").withColumn("length", F.col("l.length"))
    return records.bucketed(rows, en.history_cuts(rows.select("length")))


def _headline(source: str, name: str = "''") -> str:
    return f"""SELECT {name} || 'rwra_gain' AS comparison, session_id, 1 / lw - 1 / ls AS a, 1 / rw - 1 / rs AS b FROM {source} UNION ALL SELECT {name} || 'rwra', session_id, 1 / lw, 1 / rw FROM {source}
      UNION ALL SELECT {name} || 'left_rwra_vs_right_single', session_id, 1 / lw, 1 / rs FROM {source}"""


@query(sql("SELECT * FROM tested", **_TWO, **_tests(_headline("twin WHERE paired") + " UNION ALL SELECT 'drift', session_id, lt, rt FROM twin UNION ALL SELECT 'broken_answers', session_id, lb / la, rb / ra FROM twin")))
def model_comparisons(spark, sf_dir):
    rows = Trials(spark, sf_dir).matched_models()
    return st.paired_tests(records.headline(rows.where("paired")).unionByName(records.other_pairs(rows)))


@query(sql("SELECT * FROM tested", **_TWO, **_tests(_headline("twin WHERE paired AND lb = 0 AND rb = 0"))))
def model_comparisons_complete(spark, sf_dir):
    return st.paired_tests(records.headline(Trials(spark, sf_dir).matched_models().where("complete")))


@query(sql("SELECT * FROM tested", **_TWO, **_tests(_headline("grouped", "bucket || ':'"))))
def model_comparisons_by_history(spark, sf_dir):
    return st.paired_tests(records.headline(_by_history(Trials(spark, sf_dir)), "bucket"))


@query(sql("SELECT side, sum(broken)::BIGINT AS broken, sum(attempted)::BIGINT AS attempted, round(sum(broken) / sum(attempted), 6) AS rate FROM (SELECT 'l' AS side, lb AS broken, la AS attempted FROM twin WHERE has_l AND has_r UNION ALL SELECT 'r', rb, ra FROM twin WHERE has_l AND has_r) GROUP BY side", **_TWO))
def model_broken_answers(spark, sf_dir):
    return records.broken_answers(Trials(spark, sf_dir).matched_models())


# Calibrated ensembles ------------------------------------------------------------------------------------------------

_Z = "SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 9) END AS z FROM {} WINDOW w AS (PARTITION BY session_id, member)"
_DEB = _SMALL | {
    "z_s": _Z.format("ans_small"),
    "prior_s": "SELECT member, slot, round(avg(z), 9) AS prior FROM z_s WHERE split = 'validation' GROUP BY ALL",
    "comp": f"SELECT session_id FROM ans_small WHERE split = 'test' GROUP BY session_id HAVING count(DISTINCT member) = {N}",
    "one_rr": metrics("(SELECT session_id, member, target, split, item_id, score FROM ans_small)", "member, split"),
    "val_mrr": "SELECT member, round(avg(rr), 9) AS mrr FROM one_rr WHERE split = 'validation' GROUP BY member",
    "best_m": "SELECT max_by(member, {'m': mrr, 'n': member}) AS member FROM val_mrr",
    "own_c": "SELECT a.* FROM ans_small a WHERE session_id IN (SELECT session_id FROM comp)",
    "meth": """SELECT session_id, target, 'single_prompt_preselected' AS method, item_id, score FROM own_c WHERE member IN (SELECT member FROM best_m)
      UNION ALL SELECT session_id, target, 'naive_mean', item_id, round(avg(score), 9) FROM own_c GROUP BY session_id, target, item_id
      UNION ALL SELECT session_id, target, 'zscore_mean', item_id, round(avg(z), 9) FROM z_s WHERE session_id IN (SELECT session_id FROM comp) GROUP BY session_id, target, item_id
      UNION ALL SELECT session_id, target, 'debiased_ensemble', item_id, round(avg(z - coalesce(prior, 0)), 9) FROM z_s LEFT JOIN prior_s USING (member, slot) WHERE session_id IN (SELECT session_id FROM comp) GROUP BY session_id, target, item_id
      UNION ALL SELECT session_id, target, 'rwra', item_id, score FROM rw_small WHERE session_id IN (SELECT session_id FROM comp)""",
    "meth_all": "SELECT * FROM meth UNION ALL SELECT session_id, target, 'member:' || member, item_id, score FROM own_c",
    "meth_rr": metrics("meth_all", "method"),
}
_DEB_FAMILIES = {"primary": ev.PRIMARY, "secondary": ev.SECONDARY, "rwra": ev.AGAINST_RWRA, "members": [("rwra", f"member:{m}") for m in trials.MEMBERS]}


def _method_pairs_sql(families: dict[str, list[tuple[str, str]]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}/{a}_vs_{b}' AS comparison, session_id, max(rr) FILTER (method = '{a}') AS a, max(rr) FILTER (method = '{b}') AS b FROM {source} GROUP BY session_id" for f, pairs in families.items() for a, b in pairs)


class Debiased(Trials):
    def metrics(self) -> DataFrame:
        return self.kept("debiased", lambda: rankers.session_metrics(ev.debiased_scores(self.parsed("small"), N, alone=True), self.clean, "method"))


@query(sql(means("SELECT * FROM meth_rr", "method"), **_DEB))
def debiased_methods(spark, sf_dir):
    return rankers.method_means(Debiased(spark, sf_dir).metrics(), "method")


@query(sql(_HOLM, **_DEB, **_tests(_method_pairs_sql(_DEB_FAMILIES, "meth_rr"))))
def debiased_comparisons(spark, sf_dir):
    return _families(ev.method_pairs(Debiased(spark, sf_dir).metrics(), _DEB_FAMILIES))


@query(sql("SELECT member, mrr, member IN (SELECT member FROM best_m) AS preselected FROM val_mrr", **_DEB))
def validation_members(spark, sf_dir):
    b = Trials(spark, sf_dir)
    best = ev.preselected(b.parsed("small")).withColumn("preselected", F.lit(True))
    return ev.validation_mrr(b.parsed("small")).join(F.broadcast(best), "member", "left").withColumn("preselected", F.coalesce("preselected", F.lit(False)))


_SCORE_TAU = {
    "sgn_v": "SELECT l.session_id, l.member, l.item_id AS i, r.item_id AS j, sign(l.score - r.score) AS s FROM own_c l JOIN own_c r ON l.session_id = r.session_id AND l.member = r.member AND l.item_id < r.item_id",
    "tau_v": PARTS["tau"].replace("sgn", "sgn_v"),
}


@query(sql("SELECT count(*) AS sessions, round(avg(tau), 6) AS tau FROM (SELECT session_id, round(avg(tau), 9) AS tau FROM tau_v GROUP BY session_id)", **_DEB, **_SCORE_TAU))
def agreement_on_scores(spark, sf_dir):
    own = ev.complete_test(Trials(spark, sf_dir).parsed("small"), N)
    return ev.agreement_on_scores(own).agg(F.count("*").alias("sessions"), F.round(F.avg("tau"), 6).alias("tau"))


@query(sql("""SELECT stratum, method, count(*) AS n, round(avg(rr), 6) AS rr FROM (SELECT m.method, m.rr, CASE WHEN c.n <= a THEN 'rare' WHEN c.n <= b THEN 'moderate' ELSE 'popular' END AS stratum
  FROM meth_rr m JOIN cnt c USING (session_id), (SELECT quantile_cont(n, 1/3) AS a, quantile_cont(n, 2/3) AS b FROM cnt) WHERE m.method NOT LIKE 'member:%') GROUP BY ALL""",
  **_DEB, cnt="SELECT c.session_id, coalesce(p.n, 0) AS n FROM comp JOIN clean c USING (session_id) LEFT JOIN pop p ON p.item_id = c.target"))
def debiased_by_rarity(spark, sf_dir):
    b = Debiased(spark, sf_dir)
    rr = b.metrics().where(~F.col("method").startswith("member:"))
    counts = rr.select("session_id").distinct().join(b.clean.select("session_id", F.col("target").alias("item_id")), "session_id").join(b.pop, "item_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n"))
    return rr.join(ev.rarity(counts), "session_id").groupBy("stratum", "method").agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("rr"))


# Blends with rankers -------------------------------------------------------------------------------------------------

_W = "list_extract([0, 0.25, 0.5, 1.0]::DOUBLE[], id // {} % 4 + 1)"
_ZR = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 9) END"
_RR = """SELECT {k}, session_id, list_sum([1 / r FOR r IN range(g + 1, g + t + 2)]) / (t + 1) AS rr FROM (SELECT {k}, session_id, count(*) FILTER (s > own) AS g, count(*) FILTER (s = own) - 1 AS t FROM (
  SELECT *, max(CASE WHEN item_id = target THEN s END) OVER (PARTITION BY {k}, session_id) AS own FROM {src}) GROUP BY ALL)"""
_HYB = _DEB | {
    "full_s": f"SELECT session_id FROM ans_small GROUP BY session_id HAVING count(DISTINCT member) = {N}",
    "llm_s": "SELECT session_id, item_id, 'llm' AS ranker, round(avg(z - coalesce(prior, 0)), 9) AS score FROM z_f LEFT JOIN prior_f USING (member, slot) GROUP BY session_id, item_id",
    "z_f": "SELECT * FROM z_s WHERE session_id IN (SELECT session_id FROM full_s)",
    "prior_f": "SELECT member, slot, round(avg(z), 9) AS prior FROM z_f WHERE split = 'validation' GROUP BY ALL",
    "zpart": f"""SELECT x.*, c.split, c.target FROM (SELECT *, {_ZR} AS z FROM (SELECT session_id, item_id, ranker, score FROM scores WHERE ranker IN ({', '.join(repr(r) for r in ev.BLENDED)}) AND session_id IN (SELECT session_id FROM full_s)
      UNION ALL SELECT session_id, item_id, ranker, score FROM llm_s) WINDOW w AS (PARTITION BY session_id, ranker)) x JOIN clean c USING (session_id)""",
    "wide5": "SELECT session_id, split, target, item_id, " + ", ".join(f"max(z) FILTER (ranker = '{r}') AS z{i}" for i, r in enumerate(ev.BLENDED)) + " FROM zpart GROUP BY ALL",
    "grid5": "SELECT id, " + ", ".join(f"{_W.format(4**i)} AS w{i}" for i in range(5)) + " FROM (SELECT unnest(range(1, 1024)) AS id)",
    "blend5": "SELECT id, session_id, target, item_id, round(0.0 + " + " + ".join(f"w{i} * z{i}" for i in range(5)) + ", 9) AS s FROM wide5, grid5 WHERE split = 'validation'",
    "fit5": "SELECT id, round(avg(rr), 9) AS mrr FROM (" + _RR.format(k="id", src="blend5") + ") GROUP BY id",
    "best5": "SELECT g.*, mrr FROM fit5 JOIN grid5 g USING (id) ORDER BY mrr DESC, " + " + ".join(f"(w{i} > 0)::INT" for i in range(5)) + ", " + " + ".join(f"w{i}" for i in range(5)) + ", " + ", ".join(f"w{i}" for i in range(5)) + " LIMIT 1",
    "non": "SELECT session_id, split, target, item_id, round(" + " + ".join(f"w{i} * z{i}" for i in range(5)) + ", 9) AS score FROM wide5, best5",
    "bases": f"SELECT session_id, split, target, item_id, 'nonllm_blend' AS ranker, score, {_ZR} AS z FROM non WINDOW w AS (PARTITION BY session_id) UNION ALL SELECT session_id, split, target, item_id, ranker, score, z FROM zpart WHERE ranker IN ('item_knn', 'sequential_transitions')",
    "sums": f"SELECT b.ranker AS method, weight, b.session_id, b.split, b.target, b.item_id, round(b.z + weight * l.z, 9) AS s FROM bases b JOIN zpart l ON l.session_id = b.session_id AND l.item_id = b.item_id AND l.ranker = 'llm', (SELECT unnest({ev.LLM_GRID}::DOUBLE[]) AS weight)",
    "lgrid": "SELECT method, weight, round(avg(round(rr, 9)), 9) AS mrr FROM (" + _RR.format(k="method, weight", src="sums WHERE split = 'validation'") + ") GROUP BY ALL",
    "lbest": "SELECT method, weight FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY mrr DESC, weight) AS k FROM lgrid) WHERE k = 1",
    "hyb": """SELECT session_id, target, ranker AS method, item_id, score FROM zpart WHERE split = 'test' UNION ALL SELECT session_id, target, 'nonllm_blend', item_id, score FROM non WHERE split = 'test'
      UNION ALL SELECT session_id, target, CASE method WHEN 'nonllm_blend' THEN 'hybrid' WHEN 'item_knn' THEN 'item_knn+llm' ELSE 'sequential+llm' END, item_id, s FROM sums JOIN lbest USING (method, weight) WHERE split = 'test'""",
    "hyb_rr": metrics("hyb", "method"),
}


class Hybrid(Trials):
    """Components, fitted weights and metrics of the blends."""

    def parts(self) -> DataFrame:
        def build() -> DataFrame:
            own = en.complete(self.parsed("small"), N)
            z = en.zscored(own, "member")
            priors = self.kept("priors", lambda: en.slot_priors(en.zscored(own.where("split = 'validation'"), "member")))
            llm = self.kept("llm", lambda: en.mean_over_members(en.calibrated(z, priors), "calibrated"))
            scores = self.ranker_scores(self.random(), ev.BLENDED)
            keys, targets = llm.select("session_id").distinct(), self.clean.select("session_id", "split", "target")
            return in_rounds(self.rounds(), lambda part: ev.components(part(scores).join(part(keys), "session_id", "left_semi"), part(llm), part(targets)))

        return self.kept("parts", build)

    def weights(self) -> dict[str, float]:
        if not hasattr(self, "_weights"):
            self._weights = ev.fitted_weights(self.parts())
        return self._weights

    def bases(self) -> DataFrame:
        return self.kept("bases", lambda: in_rounds(self.rounds(), lambda part: ev.hybrid_bases(part(self.parts()), self.weights())))

    def grid(self) -> DataFrame:
        return self.kept("llm grid", lambda: ev.llm_grid(self.bases(), self.parts()))

    def metrics(self) -> DataFrame:
        def build() -> DataFrame:
            best = ev.fitted_llm_weights(self.grid())
            return in_rounds(self.rounds(), lambda part: rankers.session_metrics(ev.hybrid_scores(part(self.parts()), part(self.bases()), best), part(self.clean), "method"))

        return self.kept("hybrid", build)


_BEST5 = ", ".join(f"w{i} AS w_{r}" for i, r in enumerate(ev.BLENDED))


@query(sql(f"SELECT {_BEST5}, mrr FROM best5", **_HYB))
def hybrid_weights(spark, sf_dir):
    b = Hybrid(spark, sf_dir)
    return en.best_weights(en.blend_grid(b.parts().where("split = 'validation' AND ranker <> 'llm'"), ev.BLENDED, ev.GRID), ev.BLENDED).drop("id")


@query(sql("SELECT g.method, g.weight, g.mrr, b.weight IS NOT NULL AS chosen FROM lgrid g LEFT JOIN lbest b USING (method, weight)", **_HYB))
def hybrid_llm_weights(spark, sf_dir):
    b = Hybrid(spark, sf_dir)
    chosen = F.lit(False)
    for method, weight in ev.fitted_llm_weights(b.grid()).items():
        chosen = chosen | ((F.col("method") == method) & (F.col("weight") == weight))
    return b.grid().withColumn("chosen", chosen)


@query(sql(means("SELECT * FROM hyb_rr", "method"), **_HYB))
def hybrid_methods(spark, sf_dir):
    return rankers.method_means(Hybrid(spark, sf_dir).metrics(), "method")


@query(sql(_HOLM, **_HYB, **_tests(_method_pairs_sql(ev.HYBRID_FAMILIES, "hyb_rr"))))
def hybrid_comparisons(spark, sf_dir):
    return _families(ev.method_pairs(Hybrid(spark, sf_dir).metrics(), ev.HYBRID_FAMILIES))


_METRICS = ["rr", "hr1", "hr5", "ndcg10"]


@query(sql("SELECT ranker AS method, " + ", ".join(f"round(avg({m}) * any_value(recall), 6) AS {m}" for m in _METRICS) + " FROM (" + metrics("(SELECT s.*, c.target FROM scores s JOIN clean c USING (session_id))", "ranker") + ") m, (SELECT avg(f) AS recall FROM (SELECT session_id, max(target_retrieved::INT) AS f FROM ret_n JOIN clean USING (session_id) WHERE clean.split = 'test' GROUP BY session_id)) WHERE session_id IN (SELECT session_id FROM ret_n WHERE target_retrieved AND split = 'test') GROUP BY ranker",
  pool="SELECT session_id, split, target, item_id FROM ret_n"))
def end_to_end_rankers(spark, sf_dir):
    b = Bench(spark, sf_dir)
    own = b.kept("retrieval", lambda: pools.retrieval_pools(b.clean, rankers.retrieved(b.clean, b.train, b.pop, b.items, 20)).where("split = 'test'"))
    recall = own.groupBy("session_id").agg(F.max(F.col("target_retrieved").cast("int")).alias("f")).agg(F.avg("f").alias("recall"))
    found = pools.found_only(own)
    rr = rankers.session_metrics(b.ranker_scores(found), b.clean, "ranker").withColumnRenamed("ranker", "method")
    return ev.end_to_end(rr.groupBy("method").agg(*[F.avg(m).alias(m) for m in _METRICS]), recall, _METRICS)


# Contexts and variants -----------------------------------------------------------------------------------------------

TITLE = trials.MEMBERS[0]
_OTHERS = [m for m in trials.MEMBERS if m != TITLE]
_CTX_FAMILIES = {"contexts": [(m, "title_only") for m in _OTHERS], "ensembles": [("rwra", "title_only"), ("debiased_ensemble", "title_only")]}


def _weighted_sql(source: str, name: str) -> dict[str, str]:
    """sgn, tau, rel and the weighted scores of the members in a source of answers."""
    return {
        f"rk_{name}": f"SELECT *, row_number() OVER (PARTITION BY session_id, member ORDER BY score DESC, position) AS rank FROM {source}",
        f"sgn_{name}": PARTS["sgn"].replace("ranked", f"rk_{name}"), f"tau_{name}": PARTS["tau"].replace("sgn", f"sgn_{name}"), f"rel_{name}": PARTS["rel"].replace("FROM tau", f"FROM tau_{name}"),
        f"rw_{name}": f"SELECT session_id, target, item_id, round(sum(weight * score), 9) AS score FROM {source} JOIN rel_{name} USING (session_id, member) GROUP BY session_id, target, item_id",
    }


_CTX = _SMALL | {
    "z_c": _Z.format(f"(SELECT * FROM ans_small WHERE member <> '{TITLE}')"),
    "prior_c": "SELECT member, slot, round(avg(z), 9) AS prior FROM z_c WHERE split = 'validation' GROUP BY ALL",
    "okay": f"SELECT session_id FROM ans_small WHERE split = 'test' GROUP BY session_id HAVING count(DISTINCT member) = {N}",
    "own_x": f"SELECT * FROM ans_small WHERE member <> '{TITLE}' AND session_id IN (SELECT session_id FROM okay)",
    **_weighted_sql("own_x", "x"),
    "cmeth": f"""SELECT session_id, target, 'title_only' AS method, item_id, score FROM ans_small WHERE member = '{TITLE}' AND session_id IN (SELECT session_id FROM okay) UNION ALL SELECT session_id, target, member, item_id, score FROM own_x
      UNION ALL SELECT session_id, target, 'rwra', item_id, score FROM rw_x UNION ALL SELECT session_id, target, 'debiased_ensemble', item_id, round(avg(z - coalesce(prior, 0)), 9) FROM z_c LEFT JOIN prior_c USING (member, slot)
      WHERE session_id IN (SELECT session_id FROM okay) GROUP BY session_id, target, item_id""",
    "c_rr": metrics("cmeth", "method"),
}


class Contexts(Trials):
    def metrics(self) -> DataFrame:
        def build() -> DataFrame:
            rows = self.parsed("small").join(self.parsed("small").where(F.col("member") == TITLE).select("session_id").distinct(), "session_id", "left_semi")
            return rankers.session_metrics(ev.context_scores(rows.where(F.col("member") == TITLE), self._contexts(rows), N - 1), self.clean, "method")

        return self.kept("contexts", build)

    def _contexts(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("member") != TITLE)


_CTX["z_c"] = _Z.format(f"(SELECT * FROM ans_small WHERE member <> '{TITLE}' AND session_id IN (SELECT session_id FROM ans_small WHERE member = '{TITLE}'))")


@query(sql(means("SELECT * FROM c_rr", "method"), **_CTX))
def context_methods(spark, sf_dir):
    return rankers.method_means(Contexts(spark, sf_dir).metrics(), "method")


@query(sql(_HOLM, **_CTX, **_tests(_method_pairs_sql(_CTX_FAMILIES, "c_rr"))))
def context_comparisons(spark, sf_dir):
    return _families(ev.method_pairs(Contexts(spark, sf_dir).metrics(), _CTX_FAMILIES))


_PROMPTS = sorted({m.split(":")[0] for m in trials.MEMBERS})
_GRD_FAMILIES = {
    "primary": [("agreement_grounded", "agreement_title_only"), ("rwra_grounded", "rwra_title_only"), ("rwra_grounded", "item_knn")],
    "secondary": [("debiased_grounded", "debiased_title_only"), ("debiased_grounded", "item_knn")],
    "prompts": [(f"{p}:grounded", f"{p}:title_only") for p in _PROMPTS],
}
_GRD = _SMALL | {
    "ran": "SELECT *, split_part(member, ':', 1) AS prompt, CASE WHEN split_part(member, ':', 2) = 'title' THEN 'title_only' ELSE 'grounded' END AS run FROM ans_small",
    "z_g": _Z.format("ran"),
    "prior_g": "SELECT member, slot, round(avg(z), 9) AS prior FROM z_g WHERE split = 'validation' GROUP BY ALL",
    "okg": f"SELECT session_id FROM ran WHERE split = 'test' GROUP BY session_id HAVING count(DISTINCT member) = {N}",
    "own_t1": "SELECT * FROM ran WHERE run = 'title_only' AND session_id IN (SELECT session_id FROM okg)",
    "own_g1": "SELECT * FROM ran WHERE run = 'grounded' AND session_id IN (SELECT session_id FROM okg)",
    **_weighted_sql("own_t1", "t1"), **_weighted_sql("own_g1", "g1"),
    **{f"sv_{n}": f"SELECT l.session_id, l.member, l.item_id AS i, r.item_id AS j, sign(l.score - r.score) AS s FROM own_{n} l JOIN own_{n} r ON l.session_id = r.session_id AND l.member = r.member AND l.item_id < r.item_id" for n in ("t1", "g1")},
    **{f"tv_{n}": PARTS["tau"].replace("sgn", f"sv_{n}") for n in ("t1", "g1")},
    "gmeth": """SELECT session_id, target, prompt || ':' || run AS method, item_id, score FROM ran WHERE session_id IN (SELECT session_id FROM okg)
      UNION ALL SELECT s.session_id, c.target, 'item_knn', s.item_id, s.score FROM scores s JOIN clean c USING (session_id) WHERE ranker = 'item_knn' AND s.session_id IN (SELECT session_id FROM okg)
      UNION ALL SELECT session_id, target, 'debiased_' || run, item_id, round(avg(z - coalesce(prior, 0)), 9) FROM z_g LEFT JOIN prior_g USING (member, slot) WHERE session_id IN (SELECT session_id FROM okg) GROUP BY session_id, target, run, item_id
      UNION ALL SELECT session_id, target, 'rwra_title_only', item_id, score FROM rw_t1 UNION ALL SELECT session_id, target, 'rwra_grounded', item_id, score FROM rw_g1""",
    "g_rr": metrics("gmeth", "method"),
    "g_val": """SELECT session_id, method, rr FROM g_rr UNION ALL SELECT session_id, 'agreement_title_only', round(avg(tau), 9) FROM tv_t1 GROUP BY session_id UNION ALL SELECT session_id, 'agreement_grounded', round(avg(tau), 9) FROM tv_g1 GROUP BY session_id""",
}


class Grounding(Trials):
    def values(self) -> DataFrame:
        """session_id, method, rr of all methods and agreements, sessions by rounds."""

        def build() -> DataFrame:
            answers, contexts = self.parsed("small"), ("title", "genre")
            fit = ev.fitted(answers, *contexts)
            knn = self.ranker_scores(self.random(), ["item_knn"])

            def some(part) -> DataFrame:
                scores, tau, _ = ev.grounding(part(answers), *contexts, part(knn), fit)
                rr = rankers.session_metrics(scores, part(self.clean), "method").select("session_id", "method", "rr")
                return rr.unionByName(tau.select("session_id", "method", F.col("tau").alias("rr")))

            return in_rounds(self.rounds(), some)

        return self.kept("grounding", build)

    def moved(self) -> DataFrame:
        """session_id and moved; it needs neither scores nor a ranker."""
        rows = ev.runs(self.parsed("small"), "title", "genre").select("session_id", "split", "member", "run", "prompt", "item_id", "slot")
        prompts = sorted(r[0] for r in rows.where("run = 'grounded'").select("prompt").distinct().collect())  # a handful
        return ev.moved(ev.answered(rows, prompts))


@query(sql("SELECT method, count(*) AS n, round(avg(rr), 6) AS mean FROM g_val GROUP BY method", **_GRD))
def grounding_means(spark, sf_dir):
    return Grounding(spark, sf_dir).values().groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mean"))


@query(sql(_HOLM, **_GRD, **_tests(_method_pairs_sql(_GRD_FAMILIES, "g_val"))))
def grounding_comparisons(spark, sf_dir):
    return _families(ev.method_pairs(Grounding(spark, sf_dir).values(), _GRD_FAMILIES))


@query(sql("SELECT count(*) AS sessions, count(*) FILTER (moved) AS moved FROM (SELECT session_id, max(m) AS moved FROM (SELECT session_id, prompt, item_id, min(slot) <> max(slot) AS m FROM ran WHERE session_id IN (SELECT session_id FROM okg) GROUP BY ALL) GROUP BY session_id)", **_GRD))
def grounding_order_mismatches(spark, sf_dir):
    return Grounding(spark, sf_dir).moved().agg(F.count("*").alias("sessions"), F.count_if("moved").alias("moved"))


_RANK_METRICS = ["hr1", "hr5", "hr10", "ndcg5", "ndcg10"]
_VARIANTS = _SMALL | {"vsum": _summary("(SELECT c.session_id, m.member AS variant, r.rank FROM clean c, (SELECT DISTINCT member FROM ans_small) m LEFT JOIN (SELECT * FROM rk_small WHERE item_id = target) r ON r.session_id = c.session_id AND r.member = m.member)", "variant")}


def _variants(b: Trials) -> DataFrame:
    own = en.ranks(b.parsed("small"), "member").where("item_id = target").select("session_id", F.col("member").alias("variant"), "rank")
    all_of = b.clean.select("session_id", F.explode(F.array(*map(F.lit, trials.MEMBERS))).alias("variant"))
    return records.condition_summary(all_of.join(own, ["session_id", "variant"], "left"), "variant")


@query(sql("SELECT * FROM vsum", **_VARIANTS))
def variant_summaries(spark, sf_dir):
    return _variants(Trials(spark, sf_dir))


@query(sql("SELECT metric, best, string_agg(variant, ',' ORDER BY variant) AS variants FROM (SELECT *, max(value) OVER (PARTITION BY metric) AS best FROM (" + " UNION ALL ".join(f"SELECT variant, '{m}' AS metric, {m} AS value FROM vsum" for m in _RANK_METRICS) + ")) WHERE value = best GROUP BY ALL", **_VARIANTS))
def variant_comparison(spark, sf_dir):
    return ev.best_variants(_variants(Trials(spark, sf_dir)), _RANK_METRICS)


# The benchmark's check -----------------------------------------------------------------------------------------------

_CHECK_PAIRS = "SELECT 'matched/' || ranker AS comparison, session_id, rr AS a, 0.0 AS b FROM (" + metrics("(SELECT s.*, c.target, c.split FROM scores s JOIN clean c USING (session_id) WHERE c.split = 'test')", "ranker") + ") WHERE ranker IN ('popularity', 'inverse_popularity', 'newest_first')"
_RANDOM_RR = sum(1 / k for k in range(1, 21)) / 20


@query(sql(f"SELECT comparison, n, mean_a AS mrr, low, high, (low > {_RANDOM_RR} + 0.02 OR high < {_RANDOM_RR} - 0.02) AS shortcut FROM tested", pool="SELECT * FROM match", **_tests(_CHECK_PAIRS)))
def benchmark_shortcuts(spark, sf_dir):
    b = Bench(spark, sf_dir)
    rr = rankers.session_metrics(b.ranker_scores(b.matched(), ["popularity", "inverse_popularity", "newest_first"]), b.clean.where("split = 'test'"), "ranker")
    pairs = rr.select(F.concat(F.lit("matched/"), "ranker").alias("comparison"), "session_id", F.col("rr").alias("a"), F.lit(0.0).alias("b"))
    rows = st.paired_tests(pairs).select("comparison", "n", F.col("mean_a").alias("mrr"), "low", "high")
    return rows.withColumn("shortcut", st.shortcut(F.col("low"), F.col("high"), F.lit(_RANDOM_RR)))


@query(sql("""SELECT pool_type, count(*) AS sessions, round(avg((midrank = 1)::INT), 4) AS least_popular_share, round(avg(midrank), 2) AS midrank_mean, max(size + 1) / 2 AS expected FROM (
  SELECT pool_type, session_id, 1 + count(*) FILTER (n < own) + count(*) FILTER (n = own) / 2 AS midrank, count(*) + 1 AS size FROM (
  SELECT p.pool_type, p.session_id, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS own FROM (SELECT 'random' AS pool_type, session_id, split, target, item_id FROM rand UNION ALL SELECT 'popularity_matched', session_id, split, target, item_id FROM match) p
  LEFT JOIN pop a ON a.item_id = p.item_id LEFT JOIN pop b ON b.item_id = p.target WHERE p.item_id <> p.target AND p.split = 'test') GROUP BY ALL) GROUP BY pool_type"""))
def benchmark_targets(spark, sf_dir):
    b = Bench(spark, sf_dir)
    rows = pools.midranks(b.random().unionByName(b.matched()).where("split = 'test'"), b.pop)
    return rows.groupBy("pool_type").agg(F.count("*").alias("sessions"), F.round(F.avg((F.col("midrank") == 1).cast("int")), 4).alias("least_popular_share"), F.round(F.avg("midrank"), 2).alias("midrank_mean"), (F.max(F.col("size") + 1) / 2).alias("expected"))


@query(sql("SELECT split, count(*) AS sessions, round(avg(attribute_matched::INT), 6) AS share FROM (SELECT DISTINCT session_id, split, session_id IN (SELECT session_id FROM attr_1) AS attribute_matched FROM attr) GROUP BY split"))
def attribute_coverage(spark, sf_dir):
    b = Bench(spark, sf_dir)
    rows = pools.attribute_matched_pools(b.clean, b.pop, b.items).select("session_id", "split", "attribute_matched").distinct()
    return rows.groupBy("split").agg(F.count("*").alias("sessions"), F.round(F.avg(F.col("attribute_matched").cast("int")), 6).alias("share"))


@query(sql("SELECT (SELECT count(*) FROM rec_s) AS pools, (SELECT count(*) FROM clean) AS sessions, round((SELECT count(*) FROM rec_s) / (SELECT count(*) FROM clean), 6) AS coverage", rec_s="SELECT DISTINCT session_id FROM rec"))
def recency_coverage(spark, sf_dir):
    b = Bench(spark, sf_dir)
    made = pools.recency_matched_pools(b.clean, b.pop, pop.first_seen(b.train), b.items).select("session_id").distinct().agg(F.count("*").alias("pools"))
    return made.join(F.broadcast(b.clean.agg(F.count("*").alias("sessions")))).select("pools", "sessions", F.round(F.col("pools") / F.col("sessions"), 6).alias("coverage"))
