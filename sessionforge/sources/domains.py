"""Catalogs by name: ratings, items and genres of each, subsets of the large ones, and the files they are kept in."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import items as it
from ..functions import text as tx
from ..functions.metrics import uniform_hash
from ..operators.ordinals import id_map
from ..operators.popularity import gaps
from ..operators.sessions import k_core
from . import tables as src
from .scratch import saved

MOVIE_MEDIA = {"amazon_movies": None, "amazon_film": "movie", "amazon_tv": "tv"}
MEDIA = {"amazon_books": it.BOOKS, "amazon_music": it.MUSIC}
DOMAINS = ["movielens", "amazon_games", *MOVIE_MEDIA, *MEDIA]
MIN_INTERACTIONS, MOVIE_SHARE = 5, 0.15
RAW = T.StructType([*src.METADATA.fields, T.StructField("author", T.StructType([T.StructField("name", T.StringType())]))])
ITEMS = "item_id int, title string, genres string, subgenre string, subgenre_family string, format string, price double"
SUBSET_ITEMS = "parent_asin string, title string, genres array<string>, subgenre string, subgenre_family string, format string, price double"


def found(root: str | Path, folder: str, name: str) -> str:
    """The path of a data file, in its own folder under root or in root; fails with a hint."""
    for place in (Path(root) / folder, Path(root)):
        if (place / name).exists():
            return str(place / name)
    raise FileNotFoundError(f"{name} isn't under {root}: run the domain's prepare command first")


def movie_files(media: str | None) -> tuple[str, str]:
    """Names of the ratings and items files of all media or of one kind."""
    if media not in (None, "movie", "tv"):
        raise ValueError(f"media must be movie, tv or None, not {media!r}")
    stem = "movies_tv" if media is None else media
    return f"{stem}_ratings_subset.csv", f"{stem}_items_subset.jsonl"


# Items out of raw metadata -------------------------------------------------------------------------------------------


def _title() -> Column:
    return tx.normalised_space(F.coalesce("title", F.lit("")))


def kind_of(metadata: DataFrame) -> DataFrame:
    """Adds media: movie, tv or null."""
    minutes = tx.runtime_minutes(F.coalesce(F.nullif(F.try_element_at("details", F.lit("Run time")), F.lit("")), F.try_element_at("details", F.lit("Runtime")), F.lit("")))
    return metadata.withColumn("media", tx.media_type(F.coalesce("title", F.lit("")), F.coalesce("categories", F.array().cast("array<string>")), minutes))


def movie_items(metadata: DataFrame, media: str | None = None) -> DataFrame:
    """parent_asin, title, genres and fields of titled items, of one kind if asked."""
    movie_files(media)
    rows = kind_of(metadata).where(_title() != "")
    rows = rows if media is None else rows.where(F.col("media") == media)
    fields = it.movie_fields(F.col("title"), F.col("categories"), F.col("store"), F.col("main_category"), F.col("details"), F.col("price"))
    return rows.select("parent_asin", _title().alias("title"), F.coalesce(it.movie_genres(F.col("categories")), F.array().cast("array<string>")).alias("genres"), fields.alias("f")).select("parent_asin", "title", "genres", "f.*")


def media_items(metadata: DataFrame, catalog: it.Catalog) -> DataFrame:
    """The same of books or albums, whose titles name their creator."""
    by = tx.creator(F.col("author.name"), F.coalesce("store", F.lit("")))
    keys = F.coalesce(F.map_keys("details"), F.array().cast("array<string>"))
    fields = it.item_fields(F.col("categories"), list(catalog.genres), it.media_format(tx.store_format(F.col("store")), keys, F.col("main_category")), F.col("price"))
    rows = metadata.where(_title() != "")
    genres = F.coalesce(it.media_genre(F.col("categories"), catalog.genres), F.array().cast("array<string>"))
    return rows.select("parent_asin", tx.display_title(_title(), by).alias("title"), genres.alias("genres"), fields.alias("f")).select("parent_asin", "title", "genres", "f.*")


def game_items(metadata: DataFrame, items_map: DataFrame) -> DataFrame:
    """item_id, title, genres and fields of mapped games."""
    fields = metadata.select("parent_asin", it.game_fields(F.col("title"), F.col("categories"), F.col("price")).alias("f"))
    rows = src.game_items(metadata, items_map).join(items_map, "item_id").join(fields, "parent_asin")
    return it.item_table(rows.select("item_id", "title", "genres", "f.*"))


# Subsets -------------------------------------------------------------------------------------------------------------


def subset(raw: DataFrame, items: DataFrame, share: float, seed: int = 0, least: int = MIN_INTERACTIONS) -> tuple[DataFrame, DataFrame]:
    """Ratings of titled items by hash-chosen users, until every user and item has `least`, and the items left.

    raw: user_id, parent_asin, rating, timestamp; items: parent_asin and more. Users are chosen by a filter before the
    rounds of the core, which are written to the shared folder."""
    kept = raw.join(items.select("parent_asin"), "parent_asin", "left_semi").where(uniform_hash(F.lit(seed), F.col("user_id")) < share * 2**32)
    core = k_core(kept.withColumnRenamed("parent_asin", "item_id"), least, saved).withColumnRenamed("item_id", "parent_asin")
    return core.select("user_id", "parent_asin", "rating", "timestamp"), items.join(core.select("parent_asin").distinct(), "parent_asin", "left_semi")


def subset_summary(core: DataFrame, items: DataFrame) -> DataFrame:
    """One row: ratings, users, items, items with a genre, and the shares of gaps (timestamps in milliseconds)."""
    own = core.withColumn("item_id", F.col("parent_asin")).withColumn("timestamp", F.col("timestamp") / 1000)
    total = core.agg(F.count("*").alias("ratings"), F.count_distinct("user_id").alias("users"))
    some = items.agg(F.count("*").alias("items"), F.count_if(F.size("genres") > 0).alias("items_with_genre"))
    return total.join(F.broadcast(some)).join(F.broadcast(gaps(own)))  # single rows


def fingerprint(core: DataFrame) -> DataFrame:
    """One row: a digest of the rows whatever their order or files: the sum of 60-bit hashes, and how many they are."""
    text = F.concat_ws(",", "user_id", "parent_asin", F.col("rating").cast("string"), F.col("timestamp").cast("string"))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return core.agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("digest"))


def write_subset(core: DataFrame, items: DataFrame, ratings_path: str, items_path: str) -> None:
    """Ratings as CSV with a header, sorted by user, time and item; items as JSON lines sorted by id, keys in order."""
    ordered = core.select("user_id", "parent_asin", "rating", "timestamp").orderBy("user_id", "timestamp", "parent_asin")
    ordered.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(ratings_path)
    items.select(*sorted(items.columns)).orderBy("parent_asin").write.mode("overwrite").option("ignoreNullFields", False).json(items_path)


def build_subset(spark: SparkSession, domain: str, ratings: str, metadata: str, out: str, share: float | None = None, seed: int = 0, least: int = MIN_INTERACTIONS) -> DataFrame:
    """Reads raw ratings and metadata of a sampled domain, writes its subset under out and returns the summary. Lines of
    the metadata are only parsed for items that have ratings."""
    raw = src.read_raw_ratings(spark, ratings)
    lines = src.wanted_lines(spark, metadata, raw.select("parent_asin"), RAW)
    if domain in MEDIA:
        items, names, share = media_items(lines, MEDIA[domain]), (MEDIA[domain].ratings, MEDIA[domain].items), MEDIA[domain].share if share is None else share
    elif domain in MOVIE_MEDIA:
        items, names, share = movie_items(lines, MOVIE_MEDIA[domain]), movie_files(MOVIE_MEDIA[domain]), MOVIE_SHARE if share is None else share
    else:
        raise ValueError(f"{domain!r} has no subset; sampled domains: {', '.join([*MOVIE_MEDIA, *MEDIA])}")
    core, kept = subset(raw, saved(items), share, seed, least)
    write_subset(core, kept, f"{out}/{names[0]}", f"{out}/{names[1]}")
    return subset_summary(core, kept)


# Domains -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Domain:
    """A domain's frames: ratings (dense ids, seconds) and items (item_id, title, genres as an array)."""

    name: str
    prefix: str
    noun: str
    ratings: DataFrame
    items: DataFrame


def dense_ratings(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings under dense ids, and the maps (user_id, new_user_id) and (parent_asin, item_id)."""
    users, things = id_map(raw, "user_id", "new_user_id"), id_map(raw, "parent_asin", "item_id")
    return src.remapped(raw, users, things), users, things


def _split_genres(items: DataFrame, dropped: list[str]) -> DataFrame:
    genres = F.array_except(F.array_distinct(F.filter(F.split("genres", r"\|"), lambda g: g != "")), F.array(*map(F.lit, dropped)).cast("array<string>"))
    return items.select("item_id", "title", genres.alias("genres"))


def ratings_file(domain: str, root: str) -> str:
    """The path of a domain's ratings."""
    if domain == "movielens":
        return found(root, "ml-1m", "ratings.dat")
    if domain == "amazon_games":
        return found(root, "amazon-games", "Video_Games.csv")
    if domain in MOVIE_MEDIA:
        return found(root, "amazon-movies", movie_files(MOVIE_MEDIA[domain])[0])
    if domain in MEDIA:
        return found(root, f"amazon-{MEDIA[domain].stem}", MEDIA[domain].ratings)
    raise ValueError(f"unknown domain {domain!r}; known: {', '.join(DOMAINS)}")


def load_ratings(spark: SparkSession, domain: str, root: str) -> DataFrame:
    """Ratings of a domain (hyphens count as underscores), under dense ids and in seconds."""
    domain = domain.replace("-", "_")
    path = ratings_file(domain, root)
    return src.read_ratings(spark, path) if domain == "movielens" else dense_ratings(src.read_raw_ratings(spark, path))[0]


def load_domain(spark: SparkSession, domain: str, root: str, processed: str) -> Domain:
    """A domain's ratings, titles and genres; games lose the labels that all of them have."""
    ratings = load_ratings(spark, domain, root)
    if domain == "movielens":
        items = src.read_movies(spark, found(root, "ml-1m", "movies.dat"))
        return Domain(domain, "ml1m", "movie", ratings, _split_genres(items, []))
    items = spark.read.schema(ITEMS).json(found(processed, domain, f"{domain}_items.jsonl"))
    noun = MEDIA[domain].noun if domain in MEDIA else {"amazon_games": "game", "amazon_tv": "TV show"}.get(domain, "movie")
    return Domain(domain, domain, noun, ratings, _split_genres(items, tx.GAME_LABELS if domain == "amazon_games" else []))


def domain_items(spark: SparkSession, items_path: str, things: DataFrame) -> DataFrame:
    """The items table of a subset's items file, under the ids of the map (parent_asin, item_id)."""
    rows = spark.read.schema(SUBSET_ITEMS).json(items_path).join(things, "parent_asin")
    return it.item_table(rows.withColumn("genres", F.array_join("genres", "|")))


# Names of members, files and units ------------------------------------------------------------------------------------


def slug(model: str) -> str:
    """A model's name in file names."""
    return re.sub(r"[^a-z0-9]+", "_", model.lower()).strip("_")


def parsed_members(texts: list[str], variants: list[str], contexts: list[str]) -> list[str]:
    """Members VARIANT:CONTEXT, each once, of known variants and contexts."""
    out = []
    for text in texts:
        variant, colon, context = text.partition(":")
        if not colon or variant not in variants or context not in contexts:
            raise ValueError(f"a member must be VARIANT:CONTEXT, not {text!r}")
        out.append(text)
    if len(set(out)) != len(out):
        raise ValueError("a member is named twice")
    return out


def parsed_inputs(texts: list[str]) -> dict[str, str]:
    """Inputs NAME=PATH."""
    out = {}
    for text in texts:
        name, equals, path = text.partition("=")
        if not (name and equals and path):
            raise ValueError(f"an input must be NAME=PATH, not {text!r}")
        out[name] = path
    return out


def units(pools: DataFrame, size: int = 25) -> DataFrame:
    """Sessions in work units: pool_type, session_id, unit (by session in order, `size` a unit)."""
    from ..operators.ordinals import numbered

    rows = pools.select("pool_type", "session_id").distinct()
    return numbered(rows, "n__", "pool_type", "session_id").select("pool_type", "session_id", F.floor(F.col("n__") / size).cast("long").alias("unit"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Units' records as one table in order of session."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("session_id")


