"""Item metadata: sub-genre, format and price of an item, by kind of catalog, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mapped_genres, normalised_space, parse_price, store_format, subgenre_below

#: Category labels of films and series and the genre each stands for; other labels are none.
MOVIE_GENRES = {
    "Drama": "Drama", "Comedy": "Comedy", "Documentary": "Documentary", "Suspense": "Thriller", "Mystery & Thrillers": "Thriller", "Thriller": "Thriller", "Horror": "Horror",
    "Action": "Action & Adventure", "Adventure": "Action & Adventure", "Action & Adventure": "Action & Adventure", "Science Fiction": "Sci-Fi & Fantasy", "Fantasy": "Sci-Fi & Fantasy",
    "Science Fiction & Fantasy": "Sci-Fi & Fantasy", "Romance": "Romance", "Animation": "Animation", "Anime": "Animation", "Anime & Manga": "Animation", "Kids": "Kids & Family",
    "Kids & Family": "Kids & Family", "Family": "Kids & Family", "Special Interest": "Special Interest", "Special Interests": "Special Interest", "Exercise & Fitness": "Fitness",
    "Music Videos and Concerts": "Music & Performing Arts", "Music Videos & Concerts": "Music & Performing Arts", "Musicals & Performing Arts": "Music & Performing Arts", "Sports": "Sports",
    "Western": "Western", "Westerns": "Western", "Military and War": "War", "Military & War": "War", "Historical": "Historical", "International": "International", "Arthouse": "Arthouse",
    "Unscripted": "Unscripted", "LGBTQ": "LGBTQ", "Faith & Spirituality": "Faith & Spirituality",
}
#: Genres of music, with the labels of sales sections that stand for one, and of books.
MUSIC_GENRES = {g: g for g in (
    "Pop", "Rock", "Indie & Alternative", "Jazz", "Country", "International Music", "Classic Rock", "Classical", "Metal", "R&B", "Christian & Gospel", "Blues", "Dance & Electronic", "Rap & Hip-Hop",
    "Broadway & Vocalists", "Soundtracks", "Folk", "Opera & Classical Vocal", "Holiday & Wedding", "New Age", "Comedy & Spoken Word", "Latin Music", "Children's Music", "Reggae",
)} | {"Hard Rock & Metal": "Metal", "Alternative Rock": "Rock", "Dance & DJ": "Dance & Electronic"}
BOOK_GENRES = {g: g for g in (
    "Literature & Fiction", "Children's Books", "Mystery, Thriller & Suspense", "Crafts, Hobbies & Home", "Arts & Photography", "Christian Books & Bibles", "Teen & Young Adult", "Biographies & Memoirs",
    "History", "Cookbooks, Food & Wine", "Science Fiction & Fantasy", "Politics & Social Sciences", "Business & Money", "Romance", "Comics & Graphic Novels", "Humor & Entertainment", "Reference",
    "Science & Math", "Computers & Technology", "Travel", "Religion & Spirituality", "Health, Fitness & Dieting", "Engineering & Transportation", "Sports & Outdoors", "Education & Teaching", "Self-Help",
    "Medical Books", "LGBTQ+ Books", "Parenting & Relationships", "Law", "Test Preparation",
)}
#: Product types of games, words of a title that sell a code, formats that a film's title names, bindings
#: of books, and storefronts that are a format.
PRODUCT_TYPES = {"Games": "game", "Accessories": "accessory", "Consoles": "console", "Virtual Reality": "VR hardware"}
DIGITAL = r"(?i)digital code|online game code|download"
TITLE_FORMAT = r"(?i)(4K Ultra HD|4K UHD|Blu-ray|DVD|VHS)"
TITLE_FORMATS = {"4k ultra hd": "4K UHD", "4k uhd": "4K UHD", "blu-ray": "Blu-ray", "dvd": "DVD", "vhs": "VHS Tape"}
BINDINGS = [
    "Hardcover", "Paperback", "Mass Market Paperback", "Board book", "Library Binding", "Spiral-bound", "Spiral bound", "Perfect Paperback", "Audio CD", "Calendar", "Cards",
    "Leather Bound", "Loose Leaf", "Comic", "Flexibound", "Unbound", "Rag Book", "Bath Book",
]
STOREFRONTS = {"Buy a Kindle": "Kindle Edition", "Audible Audiobooks": "Audiobook"}
FIELDS = ("subgenre", "subgenre_family", "format", "price")


@dataclass(frozen=True)
class Catalog:
    """A sampled catalog: what an item is called, the share of users kept, the labels that are genres, file names."""

    name: str
    noun: str
    share: float
    genres: dict[str, str]
    stem: str

    @property
    def ratings(self) -> str:
        return f"{self.stem}_ratings_subset.csv"

    @property
    def items(self) -> str:
        return f"{self.stem}_items_subset.jsonl"


BOOKS = Catalog("amazon_books", "book", 0.10, BOOK_GENRES, "books")
MUSIC = Catalog("amazon_music", "album", 0.30, MUSIC_GENRES, "music")


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def item_fields(categories: Column, anchors: list[str], item_format: Column, price: Column) -> Column:
    """subgenre, subgenre_family, format and price of an item as one struct."""
    below = subgenre_below(F.coalesce(categories, F.array().cast("array<string>")), anchors)
    return F.struct(below["subgenre"].alias("subgenre"), below["family"].alias("subgenre_family"), F.coalesce(item_format, F.lit("")).alias("format"), parse_price(price).alias("price"))


def game_fields(title: Column, categories: Column, price: Column) -> Column:
    """A game's format is its product type, or digital code by its title; its sub-genre stands below the product type."""
    kinds = F.filter(F.transform(categories, lambda c: _lookup(PRODUCT_TYPES, c)), lambda x: x.isNotNull())
    shape = F.when(F.coalesce(title, F.lit("")).rlike(DIGITAL), "digital code").otherwise(F.get(kinds, F.lit(0)))
    return item_fields(categories, list(PRODUCT_TYPES), shape, price)


def movie_format(title: Column, store: Column, main_category: Column, media: Column) -> Column:
    """What the store says, else the title, else Prime Video by the storefront, else the details' media format."""
    named = _lookup(TITLE_FORMATS, F.lower(F.regexp_extract(F.coalesce(title, F.lit("")), TITLE_FORMAT, 1)))
    media = F.coalesce(media, F.lit(""))
    last = F.when(media.contains("Blu-ray"), "Blu-ray").when(media.contains("DVD"), "DVD").otherwise("")
    return F.coalesce(F.nullif(store_format(store), F.lit("")), named, F.when(main_category == "Prime Video", "Prime Video"), last)


def movie_fields(title: Column, categories: Column, store: Column, main_category: Column, details: Column, price: Column) -> Column:
    return item_fields(categories, list(MOVIE_GENRES), movie_format(title, store, main_category, F.try_element_at(details, F.lit("Media Format"))), price)


def movie_genres(categories: Column) -> Column:
    return mapped_genres(categories, MOVIE_GENRES)


def media_format(store_label: Column, keys: Column, main_category: Column) -> Column:
    """A book's or album's format: the store's, else the first binding among the details' keys, else the storefront's,
    else Kindle by a file size."""
    binding = F.get(F.filter(keys, lambda k: k.isin(BINDINGS)), F.lit(0))
    kindle = F.when(F.coalesce(F.array_contains(keys, "File size"), F.lit(False)), "Kindle Edition").otherwise("")
    return F.coalesce(F.nullif(store_label, F.lit("")), binding, _lookup(STOREFRONTS, main_category), kindle)


def media_genre(categories: Column, names: dict[str, str]) -> Column:
    """The first mapped label below the root, as an array of one or none."""
    labels = F.transform(F.slice(categories, 2, 1000), normalised_space)
    return F.slice(F.filter(F.transform(labels, lambda c: _lookup(names, c)), lambda g: g.isNotNull()), 1, 1)


def item_table(items: DataFrame) -> DataFrame:
    """item_id, title, genres and the four fields; a missing text is empty, a missing price null."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in items.columns else F.lit("").alias(c) for c in ("title", "genres", *FIELDS[:3])]
    price = F.col("price").cast("double") if "price" in items.columns else F.lit(None).cast("double")
    return items.select(F.col("item_id").cast("int").alias("item_id"), *text, price.alias("price"))


