"""Trials: presented orders, prompts, stub answers and the strict reading of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import order_hash, uniform_hash
from .sessions import SEED

MEMBERS = ["direct:title", "steps:title", "direct:genre", "steps:genre"]
#: What the simulated members add: to the first slot, and to the target.
SLOT_BIAS, SIGNAL = 25, 20


def presented(pools: DataFrame, members: list[str], seed: int = SEED) -> DataFrame:
    """Each member's seeded order of each pool: session_id, split, target, item_id, position, member, slot (0-based).
    Pools are dealt before members and order keys are added to them, so neither travels."""
    rows = pools.repartition("session_id").withColumn("member", F.explode(F.array(*map(F.lit, members))))
    key = order_hash(F.lit(seed), F.lit("present"), F.col("session_id"), F.col("member"), F.col("item_id"))
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("session_id", "member").orderBy(key, "item_id")) - 1)


def stub_scores(rows: DataFrame, size: Column) -> DataFrame:
    """The stub model's answer: size .. 1 in presented order."""
    return rows.withColumn("score", (size - F.col("slot")).cast("double"))


def hash_scores(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """A simulated member's answer from 0 to 100: seeded noise, a lean to the first slot, a lean to the target."""
    noise = F.pmod(uniform_hash(F.lit(seed), F.col("member"), F.col("session_id"), F.col("item_id")), F.lit(56))
    score = noise + F.when(F.col("slot") == 0, SLOT_BIAS).otherwise(0) + F.when(F.col("item_id") == F.col("target"), SIGNAL).otherwise(0)
    return rows.withColumn("score", score.cast("double"))


def responses(rows: DataFrame) -> DataFrame:
    """session_id, member, candidates (presented order), target and response, the JSON text of a member's answer."""
    by = rows.groupBy("session_id", "member", "target").agg(F.array_sort(F.collect_list(F.struct("slot", "item_id", "score"))).alias("a"))
    scores = F.transform("a", lambda x: x["score"])
    return by.select("session_id", "member", "target", F.transform("a", lambda x: x["item_id"]).alias("candidates"), F.to_json(F.struct(scores.alias("scores"))).alias("response"))


def parsed(rows: DataFrame) -> DataFrame:
    """Adds parse_error (null on success), scores and target_rank to rows with candidates, target and response.

    Checks in order: unique candidates, some candidates, valid JSON, an object, the key scores alone, a list, its
    length, each element a finite number from 0 to 100 and no truth value, the target among the candidates. Nothing is
    repaired. Ranks are by score, then presented order."""
    v = F.try_parse_json("response")
    keys = F.json_object_keys("response")
    raw = F.get_json_object("response", "$.scores")
    size = F.size("candidates")
    scores = F.from_json("response", "scores array<double>", {"allowNonNumericNumbers": "false"})["scores"]
    bad = F.exists(scores, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 100))
    text = F.trim("response")
    error = (
        F.when(F.size(F.array_distinct("candidates")) != size, "duplicate candidates").when(size == 0, "no candidates")
        .when(v.isNull(), "invalid JSON").when(~text.startswith("{"), "not an object")
        .when(F.coalesce(~((F.size(keys) == 1) & (keys[0] == "scores")), F.lit(True)), "wrong keys").when(raw.isNull() | ~raw.startswith("["), "not a list")
        .when(F.coalesce(F.json_array_length(raw), F.lit(-1)) != size, "wrong length").when(F.coalesce(scores.isNull() | bad, F.lit(True)), "bad score")
        .when(~F.array_contains("candidates", F.col("target")), "target missing")
    )
    out = rows.withColumn("parse_error", error).withColumn("scores", F.when(F.col("parse_error").isNull(), scores))
    order = F.array_sort(F.transform("scores", lambda x, i: F.struct((F.lit(0.0) - x).alias("s"), (i + 1).alias("p"))))
    out = out.withColumn("ranked", F.transform(order, lambda x: F.get(F.col("candidates"), x["p"] - 1)))
    return out.withColumn("target_rank", F.nullif(F.array_position("ranked", F.col("target")), F.lit(0)).cast("int"))


def sampled(sessions: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """The first n sessions in a seeded order, with their place k. A sample is what is asked for."""
    key = order_hash(F.lit(seed), F.col("session_id"))
    rows = sessions.select("session_id").distinct().orderBy(key).limit(n)
    return rows.withColumn("k", F.row_number().over(Window.orderBy(key)))  # n rows


def trial_id(session: Column, member: Column) -> Column:
    """session::variant::context."""
    return F.concat_ws("::", session, F.split(member, ":")[0], F.split(member, ":")[1])


def single_records(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Records of single-prompt trials out of parsed answers: a null response is a request that failed."""
    ok = F.col("response").isNotNull()
    error = F.when(ok, F.col("parse_error")).otherwise("request failed")
    own = rows.join(sessions.select("session_id", "split"), "session_id")
    return own.select(trial_id(F.col("session_id"), F.col("member")).alias("trial_id"), "session_id", "split", "member", "target", "candidates", "scores", F.when(error.isNull(), F.col("target_rank")).alias("target_rank"), error.isNull().alias("parse_success"), ok.alias("request_success"), error.alias("error"))


def single_evaluation(rows: DataFrame) -> DataFrame:
    """By member: trials, valid ones, mean metrics, and how many answers didn't parse and requests failed."""
    from .records import condition_summary

    base = condition_summary(rows.select("member", F.col("target_rank").alias("rank")), "member")
    failed = rows.groupBy("member").agg(F.count_if(F.col("request_success") & ~F.col("parse_success")).alias("parse_failures"), F.count_if(~F.col("request_success")).alias("request_failures"))
    return base.join(failed, "member")


def generated(prompts: DataFrame, generate, model: str) -> DataFrame:
    """Answers of a model client to rows (session_id, member, system_message, user_message): the one place where Python
    runs over rows. generate(system, user) gives text; a failure is a record with its message, not a lost row."""

    def call(frames):
        import time

        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                began = time.time()
                try:
                    out.append((r.session_id, r.member, generate(r.system_message, r.user_message), None, (time.time() - began) * 1000))
                except Exception as e:
                    out.append((r.session_id, r.member, None, f"request failed: {e}", None))
            yield pdf.__class__(out, columns=["session_id", "member", "response", "failure_reason", "latency_ms"])

    rows = prompts.select("session_id", "member", "system_message", "user_message")
    return rows.mapInPandas(call, "session_id string, member string, response string, failure_reason string, latency_ms double").withColumn("model", F.lit(model))
