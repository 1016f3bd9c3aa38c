"""Rules for titles, prices, formats and categories, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a title.
STOPWORDS = ["the", "a", "an", "of", "and", "for", "with", "to", "in", "on", "edition", "game", "games", "video", "by"]
#: Format labels that say nothing, names of nobody, labels and title words that tell series from films.
NO_FORMAT = ["", "none", "unknown binding", "unknown"]
NOBODY = ["", "none", "various", "various artists", "unknown"]
TV_LABELS, MOVIE_LABELS = ["TV", "Television"], ["Movies"]
TV_TITLE = r"(?i)\b(seasons?|complete series|series\s+(\d+|[ivx]+|one|two|three)|episodes?|mini-?series|tv series|tv show)\b"
COLLECTION_TITLE = r"(?i)\b(collection|trilogy|double feature|triple feature|\d+[- ](movies?|films?))\b| / |/.*/"
STORE_SECTION = r"(?i)\$|\bdeals?\b|\bstore\b|^general$"
#: Labels that are no genre of a game.
GAME_LABELS = ["Video Games", "Games"]


def normalised_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def title_tokens(title: Column) -> Column:
    """Distinct lower-case words of two characters or more, without (year) and stop words."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(title), r"\([0-9]{4}\)", ""), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))


#: What is cut off a title to get its series.
TITLE_YEAR, BRACKETS, SUBTITLE = r"\([0-9]{4}\)\s*$", r"\[.*?\]|\(.*?\)", r":| - "
MOVED_ARTICLE, NUMBER_AT_END = r"(?i),\s*(the|a|an)\s*$", r"(?i)\s+([0-9]+|ii|iii|iv|v|vi)\s*$"


def series_base(title: Column) -> Column:
    """The stem that titles of one series share: no year, brackets, subtitle, moved article or number at the end."""
    s = F.regexp_replace(F.regexp_replace(title, TITLE_YEAR, ""), BRACKETS, "")
    s = F.trim(F.get(F.split(s, SUBTITLE), F.lit(0)))
    s = F.regexp_replace(s, MOVED_ARTICLE, "")
    s = F.regexp_replace(F.trim(s), NUMBER_AT_END, "")
    return F.lower(normalised_space(s))


def series_text(title: Column) -> Column:
    """A title's words before its subtitle, without the year: how a series is shown."""
    return F.trim(F.get(F.split(F.regexp_replace(title, TITLE_YEAR, ""), SUBTITLE), F.lit(0)))


def ordinal_text(n: Column) -> Column:
    return F.when(n == 1, "most recent").when(n == 2, "2nd most recent").when(n == 3, "3rd most recent").otherwise(F.concat(n.cast("string"), F.lit("th most recent")))


def short(title: Column, most: int = 40) -> Column:
    return F.when(F.length(F.trim(title)) <= most, F.trim(title)).otherwise(F.concat(F.rtrim(F.substring(F.trim(title), 1, most - 1)), F.lit("…")))


def title_year(title: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(title, r"\(([0-9]{4})\)\s*$", 1), F.lit("")), F.lit("unknown"))


def parse_price(price: Column) -> Column:
    """The first number in a price, without commas, if above 0."""
    n = F.nullif(F.regexp_extract(F.regexp_replace(price, ",", ""), r"[0-9]+(\.[0-9]+)?", 0), F.lit("")).try_cast("double")
    return F.when(n > 0, n)


def clean_format(x: Column) -> Column:
    """What stands before the first run of two spaces; placeholders are empty."""
    s = F.trim(F.get(F.split(F.trim(x), r"\s{2,}"), F.lit(0)))
    return F.when(F.lower(s).isin(NO_FORMAT), "").otherwise(F.coalesce(s, F.lit("")))


def store_format(store: Column) -> Column:
    """What a store's text says after Format:."""
    return clean_format(F.regexp_extract(store, r"Format:\s*(.+)$", 1))


def subgenre_below(categories: Column, anchors: list[str]) -> Column:
    """(last, the ones before it) of the labels below the first anchor, without store sections."""
    labels = F.transform(categories, normalised_space)
    place = F.array_position(F.transform(labels, lambda c: c.isin(anchors)), True)
    below = F.when(place > 0, F.slice(labels, place.cast("int") + 1, F.greatest(F.size(labels), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    kept = F.filter(below, lambda c: (c != "") & ~c.rlike(STORE_SECTION))
    return F.struct(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")).alias("subgenre"), F.array_join(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), " > ").alias("family"))


def mapped_genres(categories: Column, names: dict[str, str]) -> Column:
    """Canonical names of known labels, in first-seen order."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(categories, lambda c: F.try_element_at(m, F.trim(c))), lambda g: g.isNotNull()))


def first_genre(categories: Column, names: dict[str, str]) -> Column:
    """The first mapped label after the root, as an array of one or none."""
    return F.slice(mapped_genres(F.slice(categories, 2, 1000), names), 1, 1)


def runtime_minutes(text: Column) -> Column:
    hours = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)\s*hour", 1), F.lit("")).cast("int"), F.lit(0))
    minutes = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)\s*min", 1), F.lit("")).cast("int"), F.lit(0))
    return F.nullif(hours * 60 + minutes, F.lit(0))


def media_type(title: Column, categories: Column, minutes: Column) -> Column:
    """tv or movie by label or title; on neither by run time: a feature is 40 to 240 minutes, longer is tv unless the
    title tells of a collection. Null on both and where nothing tells."""
    labels = F.transform(categories, lambda c: F.trim(c))
    tv = F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, TV_LABELS))), F.lit(False)) | title.rlike(TV_TITLE)
    movie = F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, MOVIE_LABELS))), F.lit(False))
    return (
        F.when(tv & movie, None).when(tv, "tv").when(movie, "movie").when(minutes.isNull() | (minutes < 40), None)
        .when(minutes <= 240, "movie").when(~title.rlike(COLLECTION_TITLE), "tv")
    )


def creator(author: Column, store: Column) -> Column:
    """The author, or the first name in the store's text."""
    name = F.trim(F.regexp_replace(F.get(F.split(F.get(F.split(store, "Format:"), F.lit(0)), r"\)\s*,"), F.lit(0)), r"\s*\(.*$", ""))
    name = normalised_space(F.coalesce(F.nullif(F.trim(author), F.lit("")), name, F.lit("")))
    return F.when(F.lower(name).isin(NOBODY) | name.startswith("Rated:"), "").otherwise(name)


def display_title(title: Column, by: Column) -> Column:
    return F.concat_ws(" by ", title, F.nullif(by, F.lit("")))


def platform(genres: Column) -> Column:
    """The platform of a game's category path; null without one."""
    path = F.filter(F.split(genres, r"\|"), lambda g: (g != "") & ~g.isin(GAME_LABELS))
    head, second = F.get(path, F.lit(0)), F.get(path, F.lit(1))
    return F.when(head.isNull() | (head == "(unknown)"), None).when(head == "Legacy Systems", F.when(second.isNotNull(), F.concat(F.lit("Legacy Systems|"), second))).otherwise(head)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def long_tail_coefficient(n: Column) -> Column:
    return F.log1p(n)


def long_tail_weight(length: Column, least: Column, most: Column, beta1: float = 0.7, beta2: float = 0.3) -> Column:
    """beta1 for the shortest history, falling with the log of its length to beta1 * beta2."""
    a, b = long_tail_coefficient(least), long_tail_coefficient(most)
    return F.greatest((b - long_tail_coefficient(length)) / F.nullif(b - a, F.lit(0.0)), F.lit(beta2)) * beta1
