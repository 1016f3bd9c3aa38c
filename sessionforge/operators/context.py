"""What a prompt's item lines say beyond the title: one renderer for each context.

A renderer takes sessions (session_id, user_id, prefix, candidates) and item features and gives long rows: session_id,
side (history or candidate), item_id, fields. History rows are those of the last HISTORY items, once an item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ordinal_text, series_base, series_text, short, title_year
from ..sources.scratch import saved
from .popularity import audience, edges, first_seen, price_tier, trend
from .rankers import followed, history_rows, knn_scores
from .sessions import exploded, ordered

HISTORY, FOLLOWED = 50, 5
STRONG, MEDIUM = 5, 10


def series(items: DataFrame) -> DataFrame:
    """item_id and series: the title text of the first item of a stem that two items or more share, else none."""
    rows = items.select("item_id", series_base(F.col("title")).alias("stem"), series_text(F.col("title")).alias("text")).where("stem <> ''")
    shown = rows.groupBy("stem").agg(F.count("*").alias("n"), F.min_by("text", "item_id").alias("series")).where("n >= 2")
    named = rows.join(exploded(shown), "stem").select("item_id", "series")
    return items.select("item_id").join(exploded(named), "item_id", "left").select("item_id", F.coalesce("series", F.lit("none")).alias("series"))


def one_digit(x: Column) -> Column:
    """A number from 1 to 7 with one digit, half to even, by the exact value of the double: its 52 binary places and
    all of its digits fit a long."""
    m = (x * F.lit(2.0**52)).cast("long")
    unit, half = F.lit(1 << 52), F.lit(1 << 51)
    down = F.shiftright(m * 10, 52)
    rest = m * 10 - down * unit
    k = down + F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"))


def item_features(train: DataFrame, popularity: DataFrame, items: DataFrame, meta: DataFrame | None = None, year_source: str = "first_seen") -> DataFrame:
    """item_id, title, genres and the parts of the contexts' fields: one row an item of the catalog.

    year_source: title (the year in it) or first_seen (the year of an item's first row). meta: item_id, subgenre,
    subgenre_family, format and price."""
    if year_source not in ("title", "first_seen"):
        raise ValueError("year_source must be title or first_seen")
    seen = first_seen(train).select("item_id", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("first_seen") / 86400).cast("int"))).cast("string").alias("first_year"))
    mean = train.groupBy("item_id").agg(F.avg("rating").alias("mean"))
    rows = items.select("item_id", "title", "genres")
    for part in (series(items), seen, mean, audience(popularity).select("item_id", "audience"), trend(train).select("item_id", "trend")):
        rows = rows.join(exploded(part), "item_id", "left")  # as broadcasts, tables of all items would meet in the driver
    year = F.concat(F.lit("year="), title_year(F.col("title"))) if year_source == "title" else F.concat(F.lit("first_seen="), F.coalesce("first_year", F.lit("unknown")))
    rows = rows.select("item_id", "title", "genres", F.coalesce("series", F.lit("none")).alias("series"), year.alias("year"), F.coalesce(F.concat(one_digit(F.col("mean")), F.lit("/5")), F.lit("n/a")).alias("rating"), F.coalesce("audience", F.lit("unseen")).alias("audience"), F.coalesce("trend", F.lit("n/a")).alias("trend"))
    if meta is None:
        return rows
    tier = price_tier(meta).withColumnRenamed("tier", "price_level")
    return rows.join(exploded(meta.select("item_id", "subgenre", "subgenre_family", "format", "price")), "item_id", "left").join(exploded(tier), "item_id", "left")


def genres_text(genres: Column, most: int = 3) -> Column:
    """The first genres, or unknown."""
    return F.when(F.size(F.coalesce(genres, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(genres, 1, most), ", ")).otherwise("unknown")


def shown(sessions: DataFrame) -> DataFrame:
    """session_id, side, item_id of what a prompt shows: the recent history and the candidates, each item once."""
    past = history_rows(sessions, HISTORY).select("session_id", F.lit("history").alias("side"), F.col("past").alias("item_id"))
    return exploded(past.unionByName(sessions.select("session_id", F.lit("candidate").alias("side"), F.explode("candidates").alias("item_id"))).distinct())


def _rendered(rows: DataFrame, fields: Column) -> DataFrame:
    return rows.select("session_id", "side", "item_id", fields.alias("fields"))


def _text(column: str, instead: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(instead))


def content(sessions: DataFrame, features: DataFrame, train: DataFrame) -> DataFrame:
    rows = shown(sessions).join(features, "item_id", "left")
    return _rendered(rows, F.concat(F.lit("genres="), genres_text(F.col("genres")), F.lit("; series="), F.coalesce("series", F.lit("none")), F.lit("; "), F.coalesce("year", F.lit("first_seen=unknown"))))


def crowd(sessions: DataFrame, features: DataFrame, train: DataFrame) -> DataFrame:
    rows = shown(sessions).join(features, "item_id", "left")
    return _rendered(rows, F.concat(F.lit("avg_rating="), F.coalesce("rating", F.lit("n/a")), F.lit("; audience="), F.coalesce("audience", F.lit("unseen")), F.lit("; trend="), F.coalesce("trend", F.lit("n/a"))))


def top_genres(sessions: DataFrame, features: DataFrame, most: int = 3) -> DataFrame:
    """session_id and top, the genres that the recent history has most often; ties by where they come first."""
    past = history_rows(sessions, HISTORY).join(features.select(F.col("item_id").alias("past"), "genres"), "past")
    rows = past.select("session_id", "back", F.posexplode("genres").alias("place", "g")).groupBy("session_id", "g")
    rows = rows.agg(F.count("*").alias("n"), F.min(F.struct((-F.col("back")).alias("b"), "place")).alias("first"))
    best = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "first"))
    return rows.withColumn("r", best).where(F.col("r") <= most).groupBy("session_id").agg(F.collect_set("g").alias("top"))


def personal(sessions: DataFrame, features: DataFrame, train: DataFrame) -> DataFrame:
    """The user's own rating (the last one of an item), how recent the item is (a repeated one as at first), and which of
    the user's most frequent genres it has."""
    own = train.groupBy("user_id", "item_id").agg(F.max_by("rating", F.struct(*[c for c in ordered(train) if c != "item_id"])).alias("score"))
    back = history_rows(sessions, HISTORY).groupBy("session_id", F.col("past").alias("item_id")).agg((F.max("back") + 1).alias("place"))
    rows = shown(sessions).join(features.select("item_id", "genres"), "item_id", "left").join(top_genres(sessions, features), "session_id", "left")
    rows = rows.join(back, ["session_id", "item_id"], "left").join(sessions.select("session_id", "user_id"), "session_id").join(own, ["user_id", "item_id"], "left")
    shared = F.array_join(F.filter("genres", lambda g: F.array_contains("top", g)), ", ")
    matches = F.coalesce(F.nullif(shared, F.lit("")), F.lit("none"))
    score = F.col("score")
    number = F.when(score == F.floor(score), F.floor(score).cast("string")).otherwise(score.cast("string"))
    label = F.when(score >= 4, "liked").when(score <= 2, "disliked").otherwise("neutral")
    rating = F.when(F.col("side") == "candidate", "not rated").when(score.isNull(), "unknown").otherwise(F.concat(label, F.lit(" ("), number, F.lit("/5)")))
    recency = F.when(F.col("side") == "candidate", "new").otherwise(ordinal_text(F.col("place")))
    return _rendered(rows, F.concat(F.lit("your_rating="), rating, F.lit("; recency="), recency, F.lit("; matches_you="), matches))


def collab(sessions: DataFrame, features: DataFrame, train: DataFrame) -> DataFrame:
    """For candidates alone: the recent item it is most often chosen with, how strong that link is among the session's
    candidates, and which of the last items it follows most often. Only pairs that are shown are counted."""
    e = edges(train, features)
    titles = features.select(F.col("item_id").alias("past"), short(F.col("title")).alias("text"))
    base = exploded(saved(sessions.select("session_id", F.explode(F.array_distinct("candidates")).alias("item_id")).distinct()))
    past = history_rows(sessions, HISTORY)
    met = knn_scores(base, past, e).withColumn("cosine", F.round("cosine", 9))
    best = met.groupBy("session_id", "item_id").agg(F.max(F.struct("cosine", "back", "past")).alias("m")).select("session_id", "item_id", "m.cosine", "m.past").join(titles, "past", "left")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("cosine"), F.desc("item_id")))
    link = F.when(place <= STRONG, "strong").when(place <= MEDIUM, "medium").otherwise("weak")
    best = best.select("session_id", "item_id", F.col("text").alias("with"), link.alias("link"))
    after = followed(base, past.where(F.col("back") < FOLLOWED), train)
    after = after.groupBy("session_id", "item_id").agg(F.max(F.struct("n", "back", "past")).alias("m")).select("session_id", "item_id", "m.past").join(titles, "past", "left")
    rows = base.join(best, ["session_id", "item_id"], "left").join(after.select("session_id", "item_id", F.col("text").alias("after")), ["session_id", "item_id"], "left").withColumn("side", F.lit("candidate"))
    return _rendered(rows, F.concat(F.lit("co_chosen_with="), F.coalesce("with", F.lit("none")), F.lit("; link="), F.coalesce("link", F.lit("none")), F.lit("; follows="), F.coalesce("after", F.lit("none"))))


def subgenre(sessions: DataFrame, features: DataFrame, train: DataFrame) -> DataFrame:
    """Sub-genre, its family, and how many of the recent items have it, an item of the history not counting itself."""
    name = features.select("item_id", F.coalesce("subgenre", F.lit("")).alias("sub"), "subgenre_family")
    past = history_rows(sessions, HISTORY).join(name.select(F.col("item_id").alias("past"), "sub"), "past", "left").where("sub <> ''")
    count = past.groupBy("session_id", "sub").agg(F.count("*").alias("n"))
    length = sessions.select("session_id", F.least(F.size("prefix"), F.lit(HISTORY)).alias("length"))
    rows = shown(sessions).join(name, "item_id", "left").join(count, ["session_id", "sub"], "left").join(length, "session_id")
    n = F.when(F.col("n").isNull(), 0).otherwise(F.col("n") - F.when(F.col("side") == "history", 1).otherwise(0))
    return _rendered(rows, F.concat(F.lit("subgenre="), _text("sub", "none"), F.lit("; family="), _text("subgenre_family", "none"), F.lit("; in_your_history="), n.cast("string"), F.lit(" of your last "), F.col("length").cast("string")))


def purchase(sessions: DataFrame, features: DataFrame, train: DataFrame) -> DataFrame:
    """Format, price and the price's tier."""
    rows = shown(sessions).join(features.select("item_id", "format", "price", "price_level"), "item_id", "left")
    priced = F.col("price") > 0
    price = F.when(priced, F.format_string("$%.2f", F.col("price"))).otherwise("unknown")
    return _rendered(rows, F.concat(F.lit("format="), _text("format", "unknown"), F.lit("; price="), price, F.lit("; price_level="), F.when(priced, F.col("price_level")).otherwise("unknown")))


Renderer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
RENDERERS: dict[str, Renderer] = {
    "context_content_v2": content, "context_crowd_v2": crowd, "context_personal_v2": personal,
    "context_collab_v2": collab, "context_subgenre_v2": subgenre, "context_format_v2": purchase,
}


def fields(variant: str, sessions: DataFrame, features: DataFrame, train: DataFrame) -> DataFrame:
    """The fields of one context; those on sub-genre and format need features with item metadata."""
    if variant not in RENDERERS:
        raise ValueError(f"unknown context {variant!r}")
    if variant in ("context_subgenre_v2", "context_format_v2") and "subgenre" not in features.columns:
        raise ValueError(f"{variant} needs item metadata")
    return RENDERERS[variant](sessions, features, train)
