"""Every registered query: a function of (session, folder) and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions import text as tx
from ..operators import ensemble as en
from ..operators import ordinals, pools, rankers, sessions, trials
from ..operators import popularity as pop
from ..operators import statistics as st
from ..sources import tables as src
from ..sources.scratch import saved
from .oracle import TIES, means, metrics, order, sql, u

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


class Bench:
    """The frames that queries share. Those that several parts of a plan read are written once, to the shared folder,
    when first asked for; each query has its own."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}
        self.inter = src.interactions(spark, sf_dir)

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = saved(build())
        return self._kept[name]

    @property
    def train(self) -> DataFrame:
        return self.kept("train", lambda: sessions.training(self.inter))

    @property
    def pop(self) -> DataFrame:
        return self.kept("pop", lambda: pop.popularity(self.train))

    @property
    def clean(self) -> DataFrame:
        return self.kept("clean", lambda: sessions.clean(self.inter))

    @property
    def items(self) -> DataFrame:
        return self.kept("items", lambda: src.items(self.spark, self.sf_dir).join(self.inter.select("item_id").distinct(), "item_id", "left_semi"))

    @property
    def edges(self) -> DataFrame:
        return self.kept("edges", lambda: pop.edges(self.train, self.items))

    def random(self) -> DataFrame:
        return self.kept("random", lambda: pools.random_pools(self.clean, self.items))

    def matched(self) -> DataFrame:
        return self.kept("matched", lambda: pools.popularity_matched_pools(self.clean, self.pop, self.items))

    def answers(self) -> DataFrame:
        return self.kept("answers", lambda: trials.hash_scores(trials.presented(self.random(), trials.MEMBERS)))

    def ranker_scores(self, chosen: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Scores of the rankers named (all), of which only those are built."""
        return rankers.all_rankers(chosen, self.clean, self.train, self.pop, self.items, names, self.edges if names is None or "item_knn" in names else None)

    def trials_of(self, scores: DataFrame) -> DataFrame:
        return scores.join(self.clean.select("session_id", "split", "target"), "session_id")


# Sources and sessions ------------------------------------------------------------------------------------------------


@query(sql("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, min(timestamp) AS first, max(timestamp) AS last FROM inter"))
def interaction_summary(spark, sf_dir):
    return src.interactions(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query("SELECT user_id, json_extract(props, '$.k')::BIGINT AS item_id, count(*) AS n, round(sum(value), 6) AS weight FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def event_items(spark, sf_dir):
    return src.event_interactions(spark, sf_dir).groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"SELECT c_custkey, {u('7', 'c_custkey')} < 0.15 * 4294967296 AS sampled FROM customer")
def user_sample(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select("c_custkey", (m.uniform_hash(F.lit(7), F.col("c_custkey")) < 0.15 * 2**32).alias("sampled"))


@query("SELECT c_name, row_number() OVER (ORDER BY c_name) AS dense_id FROM (SELECT DISTINCT c_name FROM customer)")
def dense_ids(spark, sf_dir):
    return ordinals.id_map(src.table(spark, sf_dir, "customer"), "c_name", "dense_id")


@query(sql("SELECT user_id, count(*) AS n, max(timestamp) AS last FROM train GROUP BY user_id"))
def training_users(spark, sf_dir):
    return Bench(spark, sf_dir).train.groupBy("user_id").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))


@query(sql("SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS place FROM pop"))
def item_popularity(spark, sf_dir):
    rows = Bench(spark, sf_dir).pop.withColumn("down", -F.col("n"))
    return ordinals.numbered(rows, "place", "down", "item_id").select("item_id", "n", (F.col("place") + 1).alias("place"))


@query(sql("SELECT session_id, array_to_string(prefix, ',') AS prefix, target, target_timestamp FROM ex WHERE n > 3 AND NOT list_contains(prefix, target)"))
def leave_one_out(spark, sf_dir):
    rows = sessions.leave_one_out(src.interactions(spark, sf_dir), strict=False)
    return rows.select("session_id", F.array_join(F.col("prefix").cast("array<string>"), ",").alias("prefix"), "target", "target_timestamp")


@query(sql("SELECT session_id, array_to_string(p, ',') AS prefix, target FROM (SELECT *, prefix[greatest(1, len(prefix) - 9):] AS p FROM ex WHERE n > 3) WHERE NOT list_contains(p, target)"))
def truncated_histories(spark, sf_dir):
    rows = sessions.leave_one_out(src.interactions(spark, sf_dir), max_history=10, strict=False)
    return rows.select("session_id", F.array_join(F.col("prefix").cast("array<string>"), ",").alias("prefix"), "target")


@query(sql("SELECT coalesce(drop_reason, 'clean') AS reason, count(*) AS n FROM judged GROUP BY ALL"))
def drop_reasons(spark, sf_dir):
    return sessions.judged(src.interactions(spark, sf_dir)).groupBy(F.coalesce("drop_reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("n"))


@query(sql("SELECT session_id, split, target, len(prefix) AS length FROM clean"))
def clean_sessions(spark, sf_dir):
    return Bench(spark, sf_dir).clean.select("session_id", "split", "target", F.size("prefix").alias("length"))


@query(sql("SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM clean GROUP BY split"))
def split_counts(spark, sf_dir):
    from pyspark.sql import Window

    rows = Bench(spark, sf_dir).clean.groupBy("split").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query()
def crc_split(spark, sf_dir):
    return Bench(spark, sf_dir).clean.select("session_id", sessions.split_by_crc(F.col("session_id")).alias("split"))


def _core(k: int, rounds: int) -> str:
    """The core's rows after so many rounds, of which the last change nothing."""
    parts = ["core_0 AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"]
    for i in range(1, rounds + 1):
        parts.append(f"half_{i} AS (SELECT * FROM core_{i - 1} WHERE item_id IN (SELECT item_id FROM core_{i - 1} GROUP BY item_id HAVING count(*) >= {k}))")
        parts.append(f"core_{i} AS (SELECT * FROM half_{i} WHERE user_id IN (SELECT user_id FROM half_{i} GROUP BY user_id HAVING count(*) >= {k}))")
    return f"WITH {', '.join(parts)} SELECT user_id, item_id FROM core_{rounds}"


@query(_core(20, 10))
def k_core(spark, sf_dir):
    rows = src.interactions(spark, sf_dir).select("user_id", "item_id").distinct()
    return sessions.k_core(rows, 20, saved)


# Statistics of items -------------------------------------------------------------------------------------------------


@query(sql("SELECT previous, next, n FROM trans"))
def transition_counts(spark, sf_dir):
    return pop.transitions(Bench(spark, sf_dir).train)


@query(sql("SELECT item_id, first_seen, year(to_timestamp(first_seen)) AS year, a.rating FROM seen JOIN (SELECT item_id, round(avg(rating), 6) AS rating FROM train GROUP BY item_id) a USING (item_id)"))
def first_seen(spark, sf_dir):
    train = Bench(spark, sf_dir).train
    rating = train.groupBy("item_id").agg(F.round(F.avg("rating"), 6).alias("rating"))
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("first_seen") / 86400).cast("int")))
    return pop.first_seen(train).join(rating, "item_id").select("item_id", "first_seen", year.alias("year"), "rating")


@query(sql("SELECT item_id, n, CASE WHEN n <= a THEN 'niche' WHEN n <= b THEN 'moderate' ELSE 'popular' END AS audience FROM pop, (SELECT quantile_cont(n, 1/3) AS a, quantile_cont(n, 2/3) AS b FROM pop)"))
def audience(spark, sf_dir):
    return pop.audience(Bench(spark, sf_dir).pop)


@query(sql("""SELECT item_id, n, CASE WHEN n < 5 THEN 'n/a' WHEN r > 1.5 THEN 'rising' WHEN r < 0.5 THEN 'falling' ELSE 'steady' END AS trend FROM (
  SELECT item_id, count(*) AS n, round(avg((timestamp >= cut)::INT) / any_value(total), 9) AS r FROM train, (SELECT quantile_cont(timestamp, 0.75) AS cut FROM train) c,
  (SELECT avg((timestamp >= (SELECT quantile_cont(timestamp, 0.75) FROM train))::INT) AS total FROM train) t GROUP BY item_id)"""))
def trend(spark, sf_dir):
    return pop.trend(Bench(spark, sf_dir).train)


@query("SELECT p_partkey AS item_id, CASE WHEN p_retailprice <= a THEN 'low' WHEN p_retailprice <= b THEN 'mid' WHEN p_retailprice > 0 THEN 'high' END AS tier FROM part, (SELECT quantile_cont(p_retailprice, 1/3) AS a, quantile_cont(p_retailprice, 2/3) AS b FROM part WHERE p_retailprice > 0)")
def price_tier(spark, sf_dir):
    return pop.price_tier(src.items(spark, sf_dir))


@query(sql(f"SELECT round(avg(CASE WHEN gap = 0 THEN 1 ELSE 0 END), 4) AS same_second, round(avg(CASE WHEN gap > 86400 THEN 1 ELSE 0 END), 4) AS over_a_day FROM (SELECT timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, item_id, {TIES}) AS gap FROM inter) WHERE gap IS NOT NULL"))
def gap_shares(spark, sf_dir):
    return pop.gaps(src.interactions(spark, sf_dir))


@query(sql("SELECT item_id, round(norm, 9) AS norm FROM norms"))
def item_norms(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return pop.norms(b.edges).select("item_id", F.round("norm", 9).alias("norm"))


# Pools ---------------------------------------------------------------------------------------------------------------


def _shown(p: DataFrame) -> DataFrame:
    return p.select("session_id", "split", "target", "item_id", "position")


@query(sql("SELECT * FROM rand"))
def random_pools(spark, sf_dir):
    return _shown(Bench(spark, sf_dir).random())


@query(sql("SELECT session_id, split, target, item_id, position FROM top"))
def top_popular_pools(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return _shown(pools.top_popular_pools(b.clean, b.pop))


@query(sql("SELECT * FROM match"))
def popularity_matched_pools(spark, sf_dir):
    return _shown(Bench(spark, sf_dir).matched())


@query(sql("SELECT *, session_id IN (SELECT session_id FROM attr_1) AS attribute_matched FROM attr"))
def attribute_matched_pools(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return pools.attribute_matched_pools(b.clean, b.pop, b.items).select("session_id", "split", "target", "item_id", "position", "attribute_matched")


@query(sql("SELECT * FROM rec"))
def recency_matched_pools(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return _shown(pools.recency_matched_pools(b.clean, b.pop, pop.first_seen(b.train), b.items))


@query(sql("SELECT session_id, item_id, score, r FROM ret"))
def retrieved_items(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return rankers.retrieved(b.clean, b.train, b.pop, b.items, 20)


@query(sql("SELECT session_id, split, target, item_id, target_retrieved FROM ret_n"))
def retrieval_pools(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return pools.retrieval_pools(b.clean, rankers.retrieved(b.clean, b.train, b.pop, b.items, 20)).select("session_id", "split", "target", "item_id", "target_retrieved")


@query(sql("SELECT round(avg(f), 6) AS recall, count(*) AS n FROM (SELECT session_id, max(target_retrieved::INT) AS f FROM ret_n GROUP BY session_id)"))
def retrieval_recall(spark, sf_dir):
    rows = retrieval_pools(spark, sf_dir).groupBy("session_id").agg(F.max(F.col("target_retrieved").cast("int")).alias("f"))
    return rows.agg(F.round(F.avg("f"), 6).alias("recall"), F.count("*").alias("n"))


_MID = """SELECT session_id, 1 + count(*) FILTER (n < own) + count(*) FILTER (n = own) / 2 AS midrank, count(*) + 1 AS size FROM (
  SELECT p.session_id, p.item_id, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS own FROM match p LEFT JOIN pop a ON a.item_id = p.item_id LEFT JOIN pop b ON b.item_id = p.target WHERE p.item_id <> p.target) GROUP BY session_id"""


@query(sql(f"SELECT * FROM ({_MID})"))
def target_midranks(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return pools.midranks(b.matched(), b.pop).select("session_id", "midrank", "size")


@query(sql(f"""SELECT n, q1, q2, q3, q4, q5, round(x, 6) AS chi2, round(exp(-x / 2) * (1 + x / 2), 6) AS p FROM (
  SELECT *, ((q1 - n/5)**2 + (q2 - n/5)**2 + (q3 - n/5)**2 + (q4 - n/5)**2 + (q5 - n/5)**2) / (n/5) AS x FROM (
  SELECT count(*) AS n, count(*) FILTER (b = 0) AS q1, count(*) FILTER (b = 1) AS q2, count(*) FILTER (b = 2) AS q3, count(*) FILTER (b = 3) AS q4, count(*) FILTER (b = 4) AS q5
  FROM (SELECT least(floor((midrank - 1) / size * 5), 4) AS b FROM ({_MID}))))"""))
def midrank_quintiles(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return st.uniform_quintiles(pools.midranks(b.matched(), b.pop), "pool_type").drop("pool_type")


@query(sql(f"""SELECT t, count(DISTINCT session_id) AS n FROM (SELECT session_id, 'popularity_matched' AS t FROM match UNION ALL SELECT session_id, 'random' FROM rand) JOIN
  (SELECT session_id, row_number() OVER (ORDER BY o) AS k FROM (SELECT DISTINCT session_id, {order('0', 'session_id')} AS o FROM match ORDER BY o LIMIT 500)) USING (session_id) WHERE t = 'popularity_matched' OR k <= 300 GROUP BY t"""))
def ladder_sample(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return pools.sampled_ladder(b.matched().unionByName(b.random())).groupBy(F.col("pool_type").alias("t")).agg(F.count_distinct("session_id").alias("n"))


# Rankers and metrics -------------------------------------------------------------------------------------------------


@query(sql("SELECT * FROM scores", pool="SELECT * FROM rand"))
def ranker_scores(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return b.ranker_scores(b.random())


_JOINED = "(SELECT s.*, c.target, c.split FROM scores s JOIN clean c USING (session_id))"


@query(sql(means(metrics(_JOINED, "ranker"), "ranker"), pool="SELECT * FROM match"))
def ranker_metrics(spark, sf_dir):
    b = Bench(spark, sf_dir)
    return rankers.method_means(rankers.session_metrics(b.ranker_scores(b.matched()), b.clean, "ranker"), "ranker")


@query(sql(means(metrics("(SELECT p.session_id, p.target, p.item_id, -(coalesce(r.r, 21) - 1)::DOUBLE AS score, 'retrieval_order' AS ranker FROM ret_n p LEFT JOIN ret r USING (session_id, item_id))", "ranker"), "ranker")))
def retrieval_order_metrics(spark, sf_dir):
    b = Bench(spark, sf_dir)
    ranked = rankers.retrieved(b.clean, b.train, b.pop, b.items, 20)
    scores = rankers.retrieval_order(pools.retrieval_pools(b.clean, ranked), ranked)
    return rankers.method_means(rankers.session_metrics(scores, b.clean, "ranker"), "ranker")


@query("SELECT n AS size, round(least(1, n) / n, 9) AS hr1, round(least(5, n) / n, 9) AS hr5, round(least(10, n) / n, 9) AS hr10, round(list_sum([1 / log2(r + 1) FOR r IN range(1, least(5, n) + 1)]) / n, 9) AS ndcg5, round(list_sum([1 / log2(r + 1) FOR r IN range(1, least(10, n) + 1)]) / n, 9) AS ndcg10 FROM (SELECT unnest([1, 2, 3, 10, 20, 50]) AS n)")
def expected_random(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 20, 50)], "size int")
    return rows.select("size", *[v.alias(k) for k, v in m.expected_random(F.col("size")).items()])


# Trials and ensembles ------------------------------------------------------------------------------------------------

_POOL = {"pool": "SELECT * FROM rand"}


@query(sql("SELECT member, round(avg(1 / rank), 6) AS mrr, count(*) AS n FROM ranked WHERE item_id = target GROUP BY member", **_POOL))
def member_mrr(spark, sf_dir):
    rows = en.ranks(Bench(spark, sf_dir).answers(), "member").where("item_id = target")
    return rows.groupBy("member").agg(F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), F.count("*").alias("n"))


@query(sql("SELECT max_by(member, {'m': mrr, 'n': member}) AS member, max(mrr) AS mrr FROM (SELECT member, round(avg(1 / rank), 9) AS mrr FROM ranked WHERE item_id = target AND split = 'validation' GROUP BY member)", **_POOL))
def preselected_member(spark, sf_dir):
    rows = en.ranks(Bench(spark, sf_dir).answers(), "member").where("item_id = target AND split = 'validation'")
    by = rows.groupBy("member").agg(F.round(F.avg(1 / F.col("rank")), 9).alias("mrr"))
    return by.agg(F.max_by("member", F.struct("mrr", "member")).alias("member"), F.max("mrr").alias("mrr"))


@query(sql("SELECT slot + 1 AS target_rank, count(*) AS n FROM answers WHERE item_id = target GROUP BY ALL", **_POOL))
def stub_ranks(spark, sf_dir):
    rows = trials.stub_scores(trials.presented(Bench(spark, sf_dir).random(), trials.MEMBERS), F.lit(20))
    own = trials.parsed(trials.responses(rows))
    return own.groupBy("target_rank").agg(F.count("*").alias("n"))


#: Ways to spoil a response, by the session's hash.
BROKEN = ["{0}", "not json", "[1, 2]", '{{"scores": 3}}', '{{"scores": [1, 2]}}', '{{"other": [1]}}']


@query(sql(f"""SELECT CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'not an object' WHEN 3 THEN 'not a list' WHEN 4 THEN 'wrong length' ELSE 'wrong keys' END AS outcome, count(*) AS n
  FROM (SELECT DISTINCT session_id, member, {u("'broken'", 'session_id')} % 6 AS k FROM answers) GROUP BY ALL""", **_POOL))
def parse_outcomes(spark, sf_dir):
    rows = trials.responses(Bench(spark, sf_dir).answers())
    k = F.pmod(m.uniform_hash(F.lit("broken"), F.col("session_id")), F.lit(6)).cast("int")
    spoiled = F.array(F.col("response"), *[F.lit(x.format("")) for x in BROKEN[1:]])
    own = trials.parsed(rows.withColumn("response", F.get(spoiled, k)))
    return own.groupBy(F.coalesce("parse_error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query(sql("""SELECT s.session_id, t.mean_tau, j5.j AS jaccard_5, j10.j AS jaccard_10 FROM (SELECT DISTINCT session_id FROM answers) s
  JOIN (SELECT session_id, round(avg(tau), 6) AS mean_tau FROM tau GROUP BY ALL) t USING (session_id) JOIN jac5 j5 USING (session_id) JOIN jac10 j10 USING (session_id)""",
  **_POOL, **{f"jac{k}": f"""SELECT session_id, round(avg(j), 6) AS j FROM (SELECT x.session_id, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 9) AS j
    FROM top{k} x JOIN top{k} y ON x.session_id = y.session_id AND x.member < y.member) GROUP BY ALL""" for k in (5, 10)}, **{f"top{k}": f"SELECT session_id, member, list(item_id) AS t FROM ranked WHERE rank <= {k} GROUP BY ALL" for k in (5, 10)}))  # fmt: skip
def member_agreement(spark, sf_dir):
    return en.agreement(Bench(spark, sf_dir).answers())


@query(sql("SELECT session_id, member, weight FROM rel", **_POOL))
def reliability_weights(spark, sf_dir):
    return en.reliability(Bench(spark, sf_dir).answers())


_LENGTHS = "SELECT session_id, len(prefix) AS length, min(len(prefix)) OVER () AS least, max(len(prefix)) OVER () AS most FROM clean"
_COMBINED = """(SELECT session_id, target, item_id, round(avg(score), 9) AS score, 'naive_mean' AS method FROM answers GROUP BY session_id, target, item_id
  UNION ALL SELECT session_id, target, item_id, score, 'reliability_weighted' FROM rwra
  UNION ALL SELECT r.session_id, r.target, r.item_id, round(w * r.score + (1 - w) * a.score, 9), 'long_tail_weighted' FROM rwra r JOIN answers a ON a.session_id = r.session_id AND a.item_id = r.item_id AND a.member = 'direct:title'
    JOIN (SELECT session_id, greatest((ln(most + 1) - ln(length + 1)) / nullif(ln(most + 1) - ln(least + 1), 0), 0.3) * 0.7 AS w FROM lens) l ON l.session_id = r.session_id)"""
_RWRA = {"lens": _LENGTHS, "rwra": "SELECT session_id, target, item_id, round(sum(weight * score), 9) AS score FROM answers JOIN rel USING (session_id, member) GROUP BY ALL"}


def _lengths(clean: DataFrame) -> DataFrame:
    bounds = clean.agg(F.min(F.size("prefix")).alias("least"), F.max(F.size("prefix")).alias("most"))
    return clean.select("session_id", F.size("prefix").alias("length")).join(F.broadcast(bounds))  # one row


@query(sql(means(metrics(_COMBINED, "method"), "method"), **_POOL, **_RWRA))
def ensemble_metrics(spark, sf_dir):
    b = Bench(spark, sf_dir)
    rows = en.combined(b.answers(), _lengths(b.clean), trials.MEMBERS[0])
    return rankers.method_means(rankers.session_metrics(rows.drop("target"), b.clean, "method"), "method")


@query(sql("SELECT member, slot, prior FROM priors", **_POOL))
def slot_priors(spark, sf_dir):
    return en.slot_priors(en.zscored(Bench(spark, sf_dir).answers(), "member"))


@query(sql("SELECT member, round(max(prior) - min(prior), 9) AS spread FROM priors GROUP BY member", **_POOL))
def slot_prior_spread(spark, sf_dir):
    return en.prior_spread(slot_priors(spark, sf_dir))


@query(sql(means(metrics("(SELECT *, 'calibrated' AS method FROM calib)", "method, split"), "method, split"), **_POOL))
def calibrated_metrics(spark, sf_dir):
    b = Bench(spark, sf_dir)
    z = en.zscored(b.answers(), "member")
    rows = en.mean_over_members(en.calibrated(z, en.slot_priors(z)), "calibrated").withColumn("method", F.lit("calibrated")).drop("target")
    return rankers.method_means(rankers.session_metrics(rows, b.clean, "method", "split"), "method", "split")


@query(sql("SELECT count(*) AS n, count(DISTINCT member) AS members FROM answers WHERE member NOT LIKE 'steps:%'", **_POOL))
def excluded_members(spark, sf_dir):
    return en.excluded(Bench(spark, sf_dir).answers(), ["steps"]).agg(F.count("*").alias("n"), F.count_distinct("member").alias("members"))


GRID_RANKERS = ["item_knn", "popularity", "sequential_transitions"]


@query(sql("""SELECT id, w_item_knn, w_popularity, w_sequential_transitions, round(avg(rr), 9) AS mrr FROM (
  SELECT id, session_id, any_value(a) AS w_item_knn, any_value(b) AS w_popularity, any_value(c) AS w_sequential_transitions, count(*) FILTER (s > own) AS g, count(*) FILTER (s = own) - 1 AS t,
    list_sum([1 / r FOR r IN range(g + 1, g + t + 2)]) / (t + 1) AS rr FROM (
    SELECT *, max(CASE WHEN item_id = target THEN s END) OVER (PARTITION BY id, session_id) AS own FROM (
      SELECT id, a, b, c, session_id, target, item_id, round(0.0 + a * z1 + b * z2 + c * z3, 9) AS s FROM wide, grid)) GROUP BY id, session_id) GROUP BY ALL""",
  pool="SELECT * FROM match",
  wide="SELECT session_id, target, item_id, max(z) FILTER (ranker = 'item_knn') AS z1, max(z) FILTER (ranker = 'popularity') AS z2, max(z) FILTER (ranker = 'sequential_transitions') AS z3 FROM zr WHERE split = 'validation' GROUP BY ALL",
  zr=f"SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 9) END AS z FROM {_JOINED} WINDOW w AS (PARTITION BY session_id, ranker)",
  grid="SELECT id, list_extract([0, 0.25, 0.5, 1.0]::DOUBLE[], id % 4 + 1) AS a, list_extract([0, 0.25, 0.5, 1.0]::DOUBLE[], id // 4 % 4 + 1) AS b, list_extract([0, 0.25, 0.5, 1.0]::DOUBLE[], id // 16 + 1) AS c FROM (SELECT unnest(range(1, 64)) AS id)"))
def blend_grid(spark, sf_dir):
    b = Bench(spark, sf_dir)
    scores = b.ranker_scores(b.matched(), GRID_RANKERS).join(b.clean.where("split = 'validation'").select("session_id", "target"), "session_id")
    return en.blend_grid(en.zscored(scores, "ranker"), GRID_RANKERS)


@query(sql("""SELECT min(length) FILTER (k = greatest(1, n // 3)) AS first, min(length) FILTER (k = greatest(1, 2 * n // 3)) AS second FROM (
  SELECT len(prefix) AS length, row_number() OVER (ORDER BY len(prefix)) AS k, count(*) OVER () AS n FROM clean)"""))
def history_cuts(spark, sf_dir):
    return en.history_cuts(Bench(spark, sf_dir).clean.select(F.size("prefix").alias("length")))


RANKER_PAIRS = """SELECT session_id, max(rr) FILTER (ranker = 'item_knn') AS a, max(rr) FILTER (ranker = 'popularity') AS b FROM (""" + metrics(_JOINED, "ranker") + ") GROUP BY session_id"


def ranker_pairs(spark, sf_dir) -> DataFrame:
    b = Bench(spark, sf_dir)
    rr = rankers.session_metrics(b.ranker_scores(b.matched(), ["item_knn", "popularity"]), b.clean, "ranker")
    rr = rr.groupBy("session_id").agg(F.max(F.when(F.col("ranker") == "item_knn", F.col("rr"))).alias("a"), F.max(F.when(F.col("ranker") == "popularity", F.col("rr"))).alias("b"))
    return rr.withColumn("comparison", F.lit("item_knn - popularity"))


@query(sql(f"""SELECT 'item_knn - popularity' AS comparison, count(*) AS n, round(avg(a - b), 9) AS mean, round(stddev_samp(a - b), 9) AS sd, round(avg(a - b) / stddev_samp(a - b), 9) AS effect,
  count(*) FILTER (a > b) AS improved, count(*) FILTER (a < b) AS worsened, count(*) FILTER (a = b) AS tied FROM ({RANKER_PAIRS})""", pool="SELECT * FROM match"))
def effect_sizes(spark, sf_dir):
    return st.effect_sizes(ranker_pairs(spark, sf_dir))


@query("SELECT name, p::DOUBLE AS p, p_holm::DOUBLE AS p_holm FROM (VALUES ('a', 0.01, 0.03), ('b', 0.04, 0.08), ('c', 0.5, 0.5)) v(name, p, p_holm)")
def holm_adjusted(spark, sf_dir):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.5)], "name string, p double")
    return st.holm(rows, "p").withColumn("p_holm", F.round("p_holm", 9))


@query(sql("""SELECT stratum, count(*) AS n, round(avg(rr), 6) AS rr FROM (SELECT rr, CASE WHEN c <= a THEN 'rare' WHEN c <= b THEN 'mid' ELSE 'common' END AS stratum FROM (
  SELECT m.rr, coalesce(p.n, 0) AS c FROM knn m JOIN clean USING (session_id) LEFT JOIN pop p ON p.item_id = target), (SELECT quantile_cont(coalesce(p.n, 0), 1/3) AS a, quantile_cont(coalesce(p.n, 0), 2/3) AS b FROM knn JOIN clean USING (session_id) LEFT JOIN pop p ON p.item_id = target)) GROUP BY ALL""",
  pool="SELECT * FROM match", knn=metrics("(SELECT s.*, c.target FROM scores s JOIN clean c USING (session_id) WHERE ranker = 'item_knn')")))
def rarity_strata(spark, sf_dir):
    b = Bench(spark, sf_dir)
    scores = b.ranker_scores(b.matched(), ["item_knn"])
    rr = rankers.session_metrics(scores, b.clean).join(b.clean.select("session_id", F.col("target").alias("item_id")), "session_id").join(b.pop, "item_id", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    s = pop.tertile(F.col("c"), pop.quantiles(rr, "c", 1 / 3, 2 / 3), ("rare", "mid", "common"))
    return rr.groupBy(s.alias("stratum")).agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("rr"))


@query(sql("""SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, round(avg(1 / a - 1 / b), 6) AS gain FROM (
  SELECT l.rank AS a, r.rank AS b FROM (SELECT * FROM ranked WHERE member = 'direct:title' AND item_id = target AND split = 'test') l FULL JOIN (SELECT * FROM ranked WHERE member = 'steps:title' AND item_id = target) r USING (session_id))""", **_POOL))
def model_comparison(spark, sf_dir):
    own = en.ranks(Bench(spark, sf_dir).answers(), "member").where("item_id = target")
    left = own.where("member = 'direct:title' AND split = 'test'").select("session_id", F.col("rank").alias("a"))
    right = own.where("member = 'steps:title'").select("session_id", F.col("rank").alias("b"))
    rows = left.join(right, "session_id", "full_outer")
    return rows.agg(F.count_if(F.expr("a IS NOT NULL AND b IS NOT NULL")).alias("shared"), F.count_if(F.expr("b IS NULL")).alias("only_left"), F.count_if(F.expr("a IS NULL")).alias("only_right"), F.round(F.avg(F.expr("1D / a - 1D / b")), 6).alias("gain"))


# Text rules: literal cases and their results --------------------------------------------------------------------------

_TITLES = [("Harbor Lights 2 (1998)", "harbor lights", "1998"), ("Long Winter, The (1971)", "long winter", "1971"), ("Nova: First Dawn [PC]", "nova", "unknown"), ("Iron Coast III", "iron coast", "unknown"), ("Driftwood - Extended Cut", "driftwood", "unknown")]
_PRICES = [("$12.99", 12.99), ("1,299.50 USD", 1299.5), ("0", None), ("from 5", 5.0), ("none", None)]
_PATHS = [("Video Games|Xbox One|Games", "Xbox One"), ("Video Games|Legacy Systems|Atari 2600", "Legacy Systems|Atari 2600"), ("(unknown)", None), ("Video Games|Games", None)]


def _values(rows) -> str:
    lit = lambda x: "NULL" if x is None else repr(x) if isinstance(x, float) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@query(f"SELECT * FROM ({_values(_TITLES)}) v(title, series, year)")
def title_rules(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, *_ in _TITLES], "title string").select("title", tx.series_base(F.col("title")).alias("series"), tx.title_year(F.col("title")).alias("year"))


@query(f"SELECT price, parsed::DOUBLE AS parsed FROM ({_values(_PRICES)}) v(price, parsed)")
def price_rules(spark, sf_dir):
    return spark.createDataFrame([(p,) for p, _ in _PRICES], "price string").select("price", tx.parse_price(F.col("price")).alias("parsed"))


@query(f"SELECT * FROM ({_values(_PATHS)}) v(genres, platform)")
def platform_rules(spark, sf_dir):
    return spark.createDataFrame([(p,) for p, _ in _PATHS], "genres string").select("genres", tx.platform(F.col("genres")).alias("platform"))


@query(sql("SELECT item_id, array_to_string(list_sort(words), ' ') AS words FROM tok"))
def title_words(spark, sf_dir):
    return Bench(spark, sf_dir).items.select("item_id", F.array_join(F.array_sort(tx.title_tokens(F.col("title"))), " ").alias("words"))
