"""Reference rankers: a score for each session and candidate, as long rows (session_id, item_id, ranker, score).

Scores are rounded to nine digits, so that sums of equal terms tie whatever order they were added in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import tie_aware
from ..functions.text import jaccard, title_tokens
from ..sources.scratch import in_rounds, saved
from .popularity import edges, first_seen, norms, transitions
from .sessions import exploded, recent

HISTORY, PROFILE, STEPS = 20, 50, 5


#: Users of an item up to which its list travels to the sessions; ids of users that travel at once; rows of a frame
#: from which what is built of it is saved by itself.
LISTED, AT_ONCE, MANY = 512, 100_000_000, 4_000_000


def knn_scores(pools: DataFrame, past: DataFrame, e: DataFrame) -> DataFrame:
    """Item-KNN scores of pools (session_id, item_id) against the sessions' past (session_id, past, back): session_id,
    item_id, past, back and cosine, the shared users over the two items' norms, of those that share any.

    Nearly no two items share a user where users are many, so pairs never meet their users as rows: each item of a
    session brings its list of users there and lists are met in place. Sessions come in rounds by how much that is.
    Items of more than LISTED users have no list; their pairs look up the users of the rarer item."""
    items = e.groupBy("item_id").agg(F.collect_list("user_id").alias("users"), F.count("*").alias("n"))
    items = saved(items.withColumn("users", F.when(F.col("n") <= LISTED, F.array_sort("users"))))
    pools = pools.select("session_id", "item_id")
    short, count = F.col("users").isNotNull(), F.col("n").cast("double")
    size = items.agg(F.sum(F.when(short, count * count)).alias("s"), F.sum(F.when(short, count)).alias("n"), F.count_if(~short).alias("long")).first()
    at_once = (pools.count() + past.count()) * (size["s"] or 0.0) / (size["n"] or 1.0)
    listed = exploded(items.where(short).select("item_id", "users", F.sqrt("n").alias("norm")))
    past_listed = listed.select(F.col("item_id").alias("past"), F.col("users").alias("past_users"), F.col("norm").alias("past_norm"))
    both = F.size(F.array_intersect("users", "past_users"))

    def met(part):
        rows = exploded(part(past)).join(past_listed, "past").hint("merge").join(exploded(part(pools).join(listed, "item_id")), "session_id").where(both > 0)
        return rows.select("session_id", "item_id", "past", "back", (both / (F.col("norm") * F.col("past_norm"))).alias("cosine"))

    out = in_rounds(-(-int(at_once) // AT_ONCE), met)
    return out.unionByName(_long_scores(pools, past, e, items)) if size["long"] else out


def _long_scores(pools: DataFrame, past: DataFrame, e: DataFrame, items: DataFrame) -> DataFrame:
    """The same of pairs with an item that has no list: each distinct pair once, by the users of its rarer item."""
    left = exploded(items.select("item_id", "n", F.col("users").isNull().alias("long")))
    right = left.select(F.col("item_id").alias("past"), F.col("n").alias("past_n"), F.col("long").alias("past_long"))
    a, b = pools.join(left, "item_id"), past.join(right, "past")
    asked = exploded(a.where("long")).join(b, "session_id").unionByName(exploded(a.where("NOT long")).join(b.where("past_long"), "session_id"))
    swap = F.col("n") < F.col("past_n")
    wanted = asked.select("past", "item_id", "n", "past_n").distinct().withColumn("rare", F.when(swap, F.col("item_id")).otherwise(F.col("past"))).withColumn("other", F.when(swap, F.col("past")).otherwise(F.col("item_id")))
    users = wanted.join(exploded(e.select("user_id", F.col("item_id").alias("rare"))), "rare").join(exploded(e.select("user_id", F.col("item_id").alias("other"))), ["user_id", "other"])
    shared = users.groupBy("past", "item_id", "n", "past_n").agg(F.count("*").alias("co"))
    shared = shared.select("past", "item_id", (F.col("co") / (F.sqrt("n") * F.sqrt("past_n"))).alias("cosine"))
    return asked.select("session_id", "item_id", "past", "back").join(exploded(shared), ["past", "item_id"]).select("session_id", "item_id", "past", "back", "cosine")


def followed(pools: DataFrame, past: DataFrame, train: DataFrame) -> DataFrame:
    """session_id, item_id, past, back and n, how often the item came right after that one in training, where it did."""
    t = transitions(train).select(F.col("previous").alias("past"), F.col("next").alias("item_id"), "n")
    t = saved(t) if train.count() > MANY else t
    return pools.select("session_id", "item_id").join(past, "session_id").join(exploded(t), ["past", "item_id"])


def history_rows(examples: DataFrame, n: int) -> DataFrame:
    """session_id, past and back (0 for the most recent) of the last n items of each history."""
    return exploded(examples.select("session_id", F.posexplode(F.reverse(recent(F.col("prefix"), n))).alias("back", "past")))


def simple(pools: DataFrame, train: DataFrame, popularity: DataFrame) -> DataFrame:
    """random, popularity, inverse_popularity and newest_first; an item that was never seen is newest."""
    seen = first_seen(train)
    last = seen.agg(F.coalesce(F.max("first_seen"), F.lit(0)).alias("last"))
    rows = pools.select("session_id", "item_id").join(popularity, "item_id", "left").join(seen, "item_id", "left").join(F.broadcast(last))
    n = F.coalesce("n", F.lit(0)).cast("double")
    newest = F.coalesce(F.col("first_seen"), F.col("last") + 1).cast("double")
    return rows.select("session_id", "item_id", F.inline(F.array(*[F.struct(F.lit(k).alias("ranker"), v.alias("score")) for k, v in {"random": F.lit(0.0), "popularity": n, "inverse_popularity": F.lit(0.0) - n, "newest_first": newest}.items()])))


def genre_overlap(pools: DataFrame, examples: DataFrame, items: DataFrame) -> DataFrame:
    """Share of the history's genres (with repeats) that an item's genres make up."""
    g = items.select("item_id", F.explode("genres").alias("g"))
    profile = history_rows(examples, PROFILE).join(g, F.col("past") == F.col("item_id")).groupBy("session_id", "g").agg(F.count("*").alias("c"))
    total = profile.groupBy("session_id").agg(F.sum("c").alias("total"))
    hits = exploded(pools.select("session_id", "item_id")).join(g, "item_id").join(profile, ["session_id", "g"]).join(total, "session_id")
    hits = hits.groupBy("session_id", "item_id").agg((F.sum("c") / F.max("total")).alias("s"))
    return _filled(pools, hits, "genre_overlap")


def title_overlap(pools: DataFrame, examples: DataFrame, items: DataFrame) -> DataFrame:
    """Greatest Jaccard of title words with an item of the history."""
    t = items.select("item_id", title_tokens(F.col("title")).alias("words"))
    past = history_rows(examples, PROFILE).select("session_id", "past").distinct().join(t.select(F.col("item_id").alias("past"), F.col("words").alias("past_words")), "past")
    past = past.groupBy("session_id").agg(F.collect_set("past_words").alias("all"))  # at most PROFILE sets
    rows = exploded(pools.select("session_id", "item_id")).join(t, "item_id").join(past, "session_id")
    best = F.array_max(F.transform("all", lambda w: F.coalesce(jaccard(F.col("words"), w), F.lit(0.0))))
    return _filled(pools, rows.select("session_id", "item_id", best.alias("s")), "title_overlap")


def item_knn(pools: DataFrame, examples: DataFrame, e: DataFrame) -> DataFrame:
    """e: edges of the catalog. The window of recent items is cut first, then items outside the catalog fall away;
    repeats count."""
    got = knn_scores(pools, history_rows(examples, HISTORY), e).groupBy("session_id", "item_id").agg(F.sum("cosine").alias("s"))
    return _filled(pools, got, "item_knn")


def sequential(pools: DataFrame, examples: DataFrame, train: DataFrame) -> DataFrame:
    """Transitions from the last items, the most recent counting whole, the one before half, and so on."""
    rows = followed(pools, history_rows(examples, STEPS), train)
    return _filled(pools, rows.groupBy("session_id", "item_id").agg(F.sum(F.col("n") / (F.col("back") + 1)).alias("s")), "sequential_transitions")


def _filled(pools: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    rows = pools.select("session_id", "item_id").join(scores, ["session_id", "item_id"], "left")
    return rows.select("session_id", "item_id", F.lit(name).alias("ranker"), F.round(F.coalesce("s", F.lit(0.0)), 9).alias("score"))


NAMES = ["random", "popularity", "inverse_popularity", "newest_first", "genre_overlap", "title_overlap", "item_knn", "sequential_transitions"]


def all_rankers(pools: DataFrame, examples: DataFrame, train: DataFrame, popularity: DataFrame, items: DataFrame, names: list[str] | None = None, e: DataFrame | None = None) -> DataFrame:
    """Scores of the rankers named (all); only those are built. e: edges of the catalog where they are at hand. Over many
    rows each is saved before the next one, so that their shuffles aren't on disk together."""
    names = NAMES if names is None else names
    alone = saved if pools.count() > MANY else lambda df: df
    parts = []
    if some := [n for n in names if n in NAMES[:4]]:
        parts.append(alone(simple(pools, train, popularity).where(F.col("ranker").isin(some))))
    if "genre_overlap" in names:
        parts.append(alone(genre_overlap(pools, examples, items)))
    if "title_overlap" in names:
        parts.append(alone(title_overlap(pools, examples, items)))
    if "item_knn" in names:
        parts.append(alone(item_knn(pools, examples, edges(train, items) if e is None else e)))
    if "sequential_transitions" in names:
        parts.append(alone(sequential(pools, examples, train)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retrieved(examples: DataFrame, train: DataFrame, popularity: DataFrame, catalog: DataFrame, size: int) -> DataFrame:
    """session_id, item_id and r: the item-KNN's first `size` items outside the history, by score, popularity, id.

    Items without a score come in order of popularity, so only the most popular size + longest history of them can."""
    e = edges(train, catalog)
    left = e.select("user_id", F.col("item_id").alias("past"))
    n = norms(e)
    past = history_rows(examples, HISTORY)
    used = past.select("past").distinct()
    shared = left.join(used, "past").join(e, "user_id").groupBy("past", "item_id").agg(F.count("*").alias("co"))
    shared = shared.join(n, "item_id").join(n.select(F.col("item_id").alias("past"), F.col("norm").alias("pn")), "past").select("past", "item_id", (F.col("co") / (F.col("norm") * F.col("pn"))).alias("cosine"))
    scored = past.join(shared, "past").groupBy("session_id", "item_id").agg(F.round(F.sum("cosine"), 9).alias("score"))
    longest = examples.agg(F.max(F.size("prefix"))).first()[0] or 0
    pop = catalog.select("item_id").distinct().join(popularity, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))
    head = pop.orderBy(F.desc("n"), "item_id").limit(size + longest)
    fill = examples.select("session_id").join(F.broadcast(head.select("item_id"))).withColumn("score", F.lit(0.0))  # a list bounded by the longest history
    rows = scored.unionByName(fill).groupBy("session_id", "item_id").agg(F.max("score").alias("score"))
    rows = rows.join(examples.select("session_id", "prefix"), "session_id").where(~F.array_contains("prefix", F.col("item_id"))).join(pop, "item_id")
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), F.desc("n"), "item_id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size).select("session_id", "item_id", "score", "r")


def retrieval_order(pools: DataFrame, ranked: DataFrame) -> DataFrame:
    """Minus the place in the retriever's order; items it doesn't have come after all."""
    n = ranked.groupBy("session_id").agg(F.max("r").alias("size"))
    rows = pools.select("session_id", "item_id").join(ranked.select("session_id", "item_id", "r"), ["session_id", "item_id"], "left").join(n, "session_id")
    return rows.select("session_id", "item_id", F.lit("retrieval_order").alias("ranker"), (F.lit(0.0) - (F.coalesce("r", F.col("size") + 1) - 1)).alias("score"))


def session_metrics(scores: DataFrame, targets: DataFrame, *by: str) -> DataFrame:
    """Tie-aware metrics of each session and method. scores: session_id, `by`, item_id, score; targets: session_id, target."""
    rows = exploded(scores).join(targets.select("session_id", "target"), "session_id")
    own = F.max(F.when(F.col("item_id") == F.col("target"), F.col("score"))).over(Window.partitionBy("session_id", *by))
    rows = rows.withColumn("own", own)
    counts = rows.groupBy("session_id", *by).agg(F.count_if(F.col("score") > F.col("own")).alias("greater"), (F.count_if(F.col("score") == F.col("own")) - 1).alias("tied"))
    m = tie_aware(F.col("greater").cast("int"), F.col("tied").cast("int"))
    return counts.select("session_id", *by, *[v.alias(k) for k, v in m.items()])


def method_means(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in ("rr", "hr1", "hr5", "hr10", "ndcg5", "ndcg10")])
