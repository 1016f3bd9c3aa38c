"""Candidate pools of a target and its negatives.

Pools are long: session_id, pool_type, split, target, item_id, position (0-based), with the target among the items.
Draws are hash orders, so every session's pool is the same whatever else runs, and none needs a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import order_hash, uniform_hash
from ..sources.scratch import saved
from .ordinals import numbered
from .sessions import POOL, SEED, exploded

WINDOW_FACTOR, MIN_WINDOW = 3, 30


def shuffled(chosen: DataFrame, pool_type: str, seed: int = SEED) -> DataFrame:
    """A pool's items (negatives and target) in seeded order."""
    key = order_hash(F.lit(seed), F.lit(pool_type), F.lit("order"), F.col("session_id"), F.col("item_id"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(key, "item_id")) - 1
    return chosen.withColumn("position", place).withColumn("pool_type", F.lit(pool_type))


def with_target(negatives: DataFrame, examples: DataFrame, need: int | None = None) -> DataFrame:
    """Negatives (session_id, item_id) and their sessions' targets, with split and target.

    need: how many negatives every example must have; one with fewer fails the query. Without it sessions that have no
    negatives have no pool."""
    base = examples.select("session_id", "split", "target")
    if need is None:
        base = base.join(negatives.select("session_id").distinct(), "session_id", "left_semi")
    else:
        n = F.coalesce("n__", F.lit(0))
        error = F.raise_error(F.concat(F.lit("not enough eligible negatives for "), "session_id")).cast(base.schema["target"].dataType)
        base = base.join(negatives.groupBy("session_id").agg(F.count("*").alias("n__")), "session_id", "left")
        base = base.select("session_id", "split", F.when(n >= need, F.col("target")).otherwise(error).alias("target"))
    return exploded(negatives.select("session_id", "item_id")).join(base, "session_id").unionByName(base.withColumn("item_id", F.col("target")))


def outside_history(rows: DataFrame, examples: DataFrame) -> DataFrame:
    """Rows (session_id, item_id, ...) whose item is neither in the session's history nor its target. Histories meet the
    rows as ids; they never travel in every row."""
    known = exploded(examples.select("session_id", F.explode(F.array_distinct(F.concat("prefix", F.array("target")))).alias("item_id")))
    return rows.join(known, ["session_id", "item_id"], "left_anti")


def random_pools(examples: DataFrame, catalog: DataFrame, size: int = POOL, seed: int = SEED) -> DataFrame:
    """size - 1 negatives drawn evenly from the catalog, none of the history or the target.

    Each session draws catalog numbers by hash, some more than it can lose to its history and to repeats, and keeps the
    first that count; the catalog is met by its numbers, never crossed. A session that comes up short (its history is
    nearly all of the catalog, which is then about as small as the history) takes the first of all eligible items in
    hash order instead; with fewer than size - 1 of them the query fails."""
    total, need = catalog.count(), size - 1
    listed = numbered(catalog.select("item_id").distinct(), "number", "item_id", rows=total)
    draws = F.sequence(F.lit(0), F.lit(4 * size) + 4 * F.size("prefix"))
    drawn = exploded(examples.select("session_id", F.explode(draws).alias("draw")))
    drawn = drawn.withColumn("number", F.pmod(uniform_hash(F.lit(seed), F.lit("random"), F.col("session_id"), F.col("draw")), F.lit(total)))
    first = outside_history(drawn.join(listed, "number").groupBy("session_id", "item_id").agg(F.min("draw").alias("draw")), examples)
    best = F.row_number().over(Window.partitionBy("session_id").orderBy("draw"))
    most = F.count("*").over(Window.partitionBy("session_id"))
    enough = saved(first.withColumn("n", best).withColumn("all", most).where((F.col("n") <= need) & (F.col("all") >= need)).select("session_id", "item_id"))
    short = saved(examples.join(enough.select("session_id").distinct(), "session_id", "left_anti").select("session_id", "prefix", "target"))
    if short.isEmpty() or not total:
        return shuffled(with_target(enough, examples, need), "random", seed)
    every = exploded(short.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("number"))).join(listed, "number").select("session_id", "item_id")
    key = order_hash(F.lit(seed), F.lit("random"), F.lit("rest"), F.col("session_id"), F.col("item_id"))
    rest = outside_history(every, short).withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(key, "item_id"))).where(F.col("n") <= need)
    return shuffled(with_target(enough.unionByName(rest.select("session_id", "item_id")), examples, need), "random", seed)


def top_popular_pools(examples: DataFrame, popularity: DataFrame, size: int = POOL) -> DataFrame:
    """The most popular items outside history and target; targets take the places 0 .. size - 1 in turn.

    Only the first size - 1 + longest history items can be chosen, and that short list alone meets the sessions."""
    longest = examples.agg(F.max(F.size("prefix"))).first()[0] or 0
    head = popularity.orderBy(F.desc("n"), "item_id").limit(size + longest)
    head = head.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "item_id")))
    short = head.agg(F.array_sort(F.collect_list(F.struct("r", "item_id"))).alias("head"))
    rows = examples.join(F.broadcast(short))  # one row, of at most size + longest history items
    free = F.filter(F.transform("head", lambda x: x["item_id"]), lambda i: ~F.array_contains(F.col("prefix"), i) & (i != F.col("target")))
    few = F.raise_error(F.concat(F.lit("not enough eligible negatives for "), "session_id")).cast("array<long>")
    rows = rows.withColumn("negatives", F.slice(free, 1, size - 1).cast("array<long>")).withColumn("negatives", F.when(F.size("negatives") < size - 1, few).otherwise(F.col("negatives")))
    rows = numbered(rows, "number", "user_id")
    place = (F.col("number") % size).cast("int")
    rows = rows.withColumn("target_position", place)
    items = F.concat(F.slice("negatives", F.lit(1), place), F.array(F.col("target").cast("long")), F.slice("negatives", place + 1, size))
    return rows.select("session_id", "split", "target", F.posexplode(items).alias("position", "item_id"), F.lit("top_popular").alias("pool_type"))


def ranked_groups(catalog: DataFrame, popularity: DataFrame, attributes: DataFrame | None, seed: int = SEED) -> DataFrame:
    """grp, item_id, n and place: items in ascending popularity (seeded hash within ties), in the whole catalog (group
    '') or among the items that share an attribute with the group's attribute set."""
    key = order_hash(F.lit(seed), F.col("item_id"))
    rows = catalog.select("item_id").distinct().join(popularity, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n")).withColumn("tie", key)
    if attributes is None:
        return numbered(rows, "place", "n", "tie", "item_id").select(F.lit("").alias("grp"), "item_id", "n", "place")
    kinds = attributes.select(group_of(F.col("genres")).alias("grp"), "genres").where("grp <> ''").distinct()
    wanted = kinds.select("grp", F.explode("genres").alias("g"))
    has = attributes.select("item_id", F.explode("genres").alias("g"))
    members = wanted.join(has, "g").select("grp", "item_id").distinct().join(rows, "item_id")
    order = Window.partitionBy("grp").orderBy("n", "tie", "item_id")
    return members.withColumn("place", F.row_number().over(order) - 1).select("grp", "item_id", "n", "place")


def group_of(genres: Column) -> Column:
    """The name of an attribute set; '' for none."""
    return F.coalesce(F.array_join(F.array_sort(genres), "|"), F.lit(""))


def places(asked: DataFrame, groups: DataFrame, popularity: DataFrame) -> DataFrame:
    """asked (session_id, prefix, target, grp) with at, the target's place in its group's order, and listed. A target
    that the group doesn't have stands before the items of its count, by one pass over the groups' distinct counts."""
    own = groups.select("grp", F.col("item_id").alias("target"), F.col("place").alias("at"))
    rows = asked.join(own, ["grp", "target"], "left")
    known = rows.where("at IS NOT NULL").withColumn("listed", F.lit(True))
    lost = rows.where("at IS NULL").drop("at").join(popularity.select(F.col("item_id").alias("target"), "n"), "target", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    steps = groups.groupBy("grp", F.col("n").cast("long").alias("n")).agg(F.min("place").alias("step"))
    ends = groups.groupBy("grp").agg((F.max("place") + 1).alias("end"))
    both = lost.withColumn("step", F.lit(None).cast("long")).unionByName(steps, allowMissingColumns=True)
    after = F.min("step").over(Window.partitionBy("grp").orderBy("n").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("at", after).where("session_id IS NOT NULL").join(ends, "grp")
    return known.unionByName(found.withColumn("at", F.coalesce("at", "end")).withColumn("listed", F.lit(False)).select(*known.columns))


def matched_negatives(asked: DataFrame, groups: DataFrame, popularity: DataFrame, label: str, size: int = POOL, seed: int = SEED) -> DataFrame:
    """Negatives near the target in its group's order: session_id, item_id, only of sessions that get all size - 1.

    asked: session_id, prefix, target, grp. k of them are below the target, k drawn evenly; each side is drawn from
    its nearest max(3 * count, 30) items outside the history; a side that is too short lends to the other. The band of
    places that can matter is as long as the widest window and the history, and is met by place: an equi-join."""
    widest = max(WINDOW_FACTOR * (size - 1), MIN_WINDOW)
    anchor = places(asked, groups, popularity)
    reach = F.lit(widest) + F.size("prefix")
    band = anchor.select("session_id", "grp", "at", "listed", F.explode(F.sequence(F.greatest(F.col("at") - reach, F.lit(0)), F.col("at") + reach)).alias("place"))
    rows = band.where("NOT listed OR place <> at").join(groups.select("grp", "place", "item_id"), ["grp", "place"])
    rows = outside_history(rows, asked).withColumn("below", F.col("place") < F.col("at"))
    rows = rows.withColumn("k", F.pmod(uniform_hash(F.lit(seed), F.lit(label), F.col("session_id")), F.lit(size)).cast("int"))
    near = Window.partitionBy("session_id", "below").orderBy(F.abs(F.col("place") - F.col("at")))
    rows = rows.withColumn("near", F.row_number().over(near))
    side = Window.partitionBy("session_id")
    rows = rows.withColumn("has_below", F.least(F.count_if("below").over(side), F.lit(widest))).withColumn("has_above", F.least(F.count_if(~F.col("below")).over(side), F.lit(widest)))
    need = size - 1
    k = F.when(F.col("has_below") < F.col("k"), F.col("has_below")).when(F.col("has_above") < need - F.col("k"), need - F.col("has_above")).otherwise(F.col("k"))
    rows = rows.withColumn("k", k).where((F.col("k") >= 0) & (F.col("has_below") >= F.col("k")) & (F.col("has_above") >= need - F.col("k")))
    rows = rows.withColumn("count", F.when(F.col("below"), F.col("k")).otherwise(need - F.col("k")))
    rows = rows.where(F.col("near") <= F.greatest(WINDOW_FACTOR * F.col("count"), F.lit(MIN_WINDOW)))
    draw = order_hash(F.lit(seed), F.lit(label), F.lit("draw"), F.col("session_id"), F.col("item_id"))
    pick = F.row_number().over(Window.partitionBy("session_id", "below").orderBy(draw, "item_id"))
    return rows.withColumn("pick", pick).where(F.col("pick") <= F.col("count")).select("session_id", "item_id")


def popularity_matched_pools(examples: DataFrame, popularity: DataFrame, catalog: DataFrame, size: int = POOL, seed: int = SEED) -> DataFrame:
    groups = ranked_groups(catalog, popularity, None, seed)
    asked = examples.select("session_id", "prefix", "target", F.lit("").alias("grp"))
    negatives = saved(matched_negatives(asked, groups, popularity, "matched", size, seed))
    return shuffled(with_target(negatives, examples, size - 1), "popularity_matched", seed)


def attribute_matched_pools(examples: DataFrame, popularity: DataFrame, items: DataFrame, size: int = POOL, seed: int = SEED) -> DataFrame:
    """As popularity matched, among items that share an attribute with the target; where those are too few, among all,
    and attribute_matched is false. items: item_id, genres, the catalog."""
    own = examples.join(items.select(F.col("item_id").alias("target"), group_of(F.col("genres")).alias("grp")), "target", "left").withColumn("grp", F.coalesce("grp", F.lit("")))
    groups = ranked_groups(items, popularity, items, seed)
    first = saved(matched_negatives(own.where("grp <> ''").select("session_id", "prefix", "target", "grp"), groups, popularity, "attribute_matched", size, seed))
    rest = saved(examples.join(first.select("session_id").distinct(), "session_id", "left_anti"))
    asked = rest.select("session_id", "prefix", "target", F.lit("").alias("grp"))
    second = saved(matched_negatives(asked, ranked_groups(items, popularity, None, seed), popularity, "attribute_matched:fallback", size, seed))
    both = with_target(first, examples).withColumn("attribute_matched", F.lit(True)).unionByName(with_target(second, rest, size - 1).withColumn("attribute_matched", F.lit(False)))
    return shuffled(both, "attribute_matched", seed)


def recency_matched_pools(examples: DataFrame, popularity: DataFrame, seen: DataFrame, items: DataFrame, size: int = POOL, seed: int = SEED) -> DataFrame:
    """Negatives matched on popularity and on first time at once: for each key a drawn number of them ranks below the
    target. Sessions that can't have size - 1 on each side of each key, or whose draws don't fit, get no pool.

    With k1 and k2 below on the two keys, the four cells (below or above on each) hold a, k1 - a, k2 - a and the rest;
    a is drawn from the interval in which no cell asks for more than it has."""
    need, widest = size - 1, max(WINDOW_FACTOR * (size - 1), MIN_WINDOW)
    base = items.select("item_id", "genres").join(popularity, "item_id", "left").join(seen, "item_id", "left")
    base = base.select("item_id", "genres", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_seen", F.lit((1 << 62))).alias("seen"), order_hash(F.lit(seed), F.col("item_id")).alias("tie"))
    kinds = base.select(group_of(F.col("genres")).alias("grp"), "genres").where("grp <> ''").distinct()
    members = kinds.select("grp", F.explode("genres").alias("g")).join(base.select("item_id", "n", "seen", "tie", F.explode("genres").alias("g")), "g").drop("g").distinct()
    members = members.withColumn("size", F.count("*").over(Window.partitionBy("grp"))).where(F.col("size") > 2 * need).drop("size")
    members = members.unionByName(base.select(F.lit("").alias("grp"), "item_id", "n", "seen", "tie"))
    members = members.withColumn("r1", F.row_number().over(Window.partitionBy("grp").orderBy("n", "tie", "item_id"))).withColumn("r2", F.row_number().over(Window.partitionBy("grp").orderBy("seen", "tie", "item_id")))
    own = examples.join(items.select(F.col("item_id").alias("target"), group_of(F.col("genres")).alias("grp")), "target")
    large = members.select("grp").distinct()
    own = own.join(large.withColumn("large", F.lit(True)), "grp", "left").withColumn("grp", F.when(F.col("large"), F.col("grp")).otherwise("")).drop("large")
    own = own.join(members.select("grp", F.col("item_id").alias("target"), F.col("n").alias("tn"), F.col("r1").alias("t1"), F.col("r2").alias("t2")), ["grp", "target"])
    for i in (1, 2):
        own = own.withColumn(f"k{i}", F.pmod(uniform_hash(F.lit(seed), F.lit(f"recency:{i}"), F.col("session_id")), F.lit(size)).cast("int"))
    rows = own.select("session_id", "prefix", "target", "grp", "tn", "t1", "t2", "k1", "k2").join(members, "grp").where((F.col("n") != F.col("tn")) & ~F.array_contains("prefix", F.col("item_id")))
    rows = rows.withColumn("b1", F.col("r1") < F.col("t1")).withColumn("b2", F.col("r2") < F.col("t2"))
    cells = rows.groupBy("session_id", "k1", "k2").agg(F.count_if(F.expr("b1 and b2")).alias("tt"), F.count_if(F.expr("b1 and not b2")).alias("tf"), F.count_if(F.expr("not b1 and b2")).alias("ft"), F.count_if(F.expr("not b1 and not b2")).alias("ff"))
    cells = cells.where((F.col("tt") + F.col("tf") >= need) & (F.col("ft") + F.col("ff") >= need) & (F.col("tt") + F.col("ft") >= need) & (F.col("tf") + F.col("ff") >= need))
    low = F.greatest(F.lit(0), F.col("k1") + F.col("k2") - need, F.col("k1") - F.col("tf"), F.col("k2") - F.col("ft"))
    high = F.least(F.col("k1"), F.col("k2"), F.col("tt"), F.col("ff") - need + F.col("k1") + F.col("k2"))
    cells = cells.withColumn("low", low).withColumn("high", high).where("low <= high")
    cells = cells.withColumn("a", F.col("low") + F.pmod(uniform_hash(F.lit(seed), F.lit("recency:a"), F.col("session_id")), F.col("high") - F.col("low") + 1))
    rows = rows.join(cells.select("session_id", "a"), "session_id")
    count = F.when(F.expr("b1 and b2"), F.col("a")).when(F.expr("b1"), F.col("k1") - F.col("a")).when(F.expr("b2"), F.col("k2") - F.col("a")).otherwise(need - F.col("k1") - F.col("k2") + F.col("a"))
    rows = rows.withColumn("count", count)
    distance = F.abs(F.col("r1") - F.col("t1")) + F.abs(F.col("r2") - F.col("t2"))
    near = F.row_number().over(Window.partitionBy("session_id", "b1", "b2").orderBy(distance, "tie", "item_id"))
    rows = rows.withColumn("near", near).where(F.col("near") <= widest).where(F.col("near") <= F.greatest(WINDOW_FACTOR * F.col("count"), F.lit(MIN_WINDOW)))
    draw = order_hash(F.lit(seed), F.lit("recency:draw"), F.col("session_id"), F.col("item_id"))
    pick = F.row_number().over(Window.partitionBy("session_id", "b1", "b2").orderBy(draw, "item_id"))
    negatives = rows.withColumn("pick", pick).where(F.col("pick") <= F.col("count")).select("session_id", "item_id")
    return shuffled(with_target(negatives, examples), "recency_matched", seed)


def retrieval_pools(examples: DataFrame, retrieved: DataFrame, size: int = POOL, seed: int = SEED) -> DataFrame:
    """A retriever's own first `size` items (session_id, item_id, r); a target that is none of them replaces the last,
    and target_retrieved is false."""
    top = retrieved.where(F.col("r") <= size)
    found = top.join(examples.select("session_id", "target"), "session_id").groupBy("session_id").agg(F.max((F.col("item_id") == F.col("target")).cast("int")).alias("found"))
    rows = top.join(found, "session_id").join(examples.select("session_id", "split", "target"), "session_id")
    item = F.when((F.col("found") == 0) & (F.col("r") == size), F.col("target")).otherwise(F.col("item_id"))
    rows = rows.select("session_id", "split", "target", item.alias("item_id"), (F.col("found") == 1).alias("target_retrieved"))
    return shuffled(rows, "retrieval", seed)


def found_only(pools: DataFrame) -> DataFrame:
    """Retrieval pools whose target the retriever found."""
    return pools.where("target_retrieved")


def sampled_ladder(pools: DataFrame, base_type: str = "popularity_matched", base: int = 500, rest: int = 300, seed: int = SEED) -> DataFrame:
    """`base` sessions of the base level by hash order, of which the other levels keep the first `rest`."""
    key = order_hash(F.lit(seed), F.col("session_id"))
    own = pools.where(F.col("pool_type") == base_type).select("session_id").distinct().orderBy(key).limit(base)
    own = own.withColumn("n", F.row_number().over(Window.orderBy(key)))
    rows = pools.join(F.broadcast(own), "session_id")  # at most `base` rows
    return rows.where((F.col("pool_type") == base_type) | (F.col("n") <= rest)).drop("n")


def midranks(pools: DataFrame, popularity: DataFrame) -> DataFrame:
    """The target's popularity rank in its pool from the bottom, ties averaged."""
    rows = pools.join(popularity, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = rows.where("item_id = target").select("session_id", "pool_type", F.col("n").alias("own"))
    rows = rows.where("item_id <> target").join(own, ["session_id", "pool_type"])
    return rows.groupBy("session_id", "pool_type", "split").agg((1 + F.count_if(F.col("n") < F.col("own")) + F.count_if(F.col("n") == F.col("own")) / 2).alias("midrank"), (F.count("*") + 1).alias("size"))
