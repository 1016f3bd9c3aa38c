"""Queries of item metadata, subsets, work units, single-prompt runs and power, with their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import items as it
from ..functions.metrics import uniform_hash
from ..operators import records, trials
from ..operators import statistics as st
from ..sources import domains
from ..sources import tables as src
from .oracle import order, sql, u
from .registry import Bench, query
from .reports import _OUT, Trials, _summary, _tests

# Literal cases and their results -------------------------------------------------------------------------------------

_RAW = "parent_asin string, title string, categories array<string>, details map<string,string>, store string, main_category string, price string, author struct<name:string>"


def _metadata(spark, rows):
    keys = ("title", "categories", "details", "store", "main_category", "price", "author")
    return spark.createDataFrame([(f"A{i}", *[r.get(k) for k in keys]) for i, r in enumerate(rows)], _RAW)


def _values(rows) -> str:
    lit = lambda x: "NULL" if x is None else repr(x) if isinstance(x, (float, int)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_GAMES = [
    ({"title": "Star Harbor", "categories": ["Video Games", "PC", "Games"], "price": "$19.99"}, ("", "", "game", 19.99)),
    ({"title": "Star Harbor [Online Game Code]", "categories": ["Video Games", "PC", "Games"], "price": "5"}, ("", "", "digital code", 5.0)),
    ({"title": "Night Headset", "categories": ["Video Games", "Xbox One", "Accessories", "Headsets", "Wireless"], "price": None}, ("Wireless", "Headsets", "accessory", None)),
    ({"title": "Box", "categories": ["Video Games", "Consoles"], "price": "free"}, ("", "", "console", None)),
    ({"title": None, "categories": ["Video Games", "Sale Store"], "price": "0"}, ("", "", "", None)),
]


@query(f"SELECT id, subgenre, subgenre_family, format, price::DOUBLE AS price FROM ({_values([(f'A{i}', *w) for i, (_, w) in enumerate(_GAMES)])}) v(id, subgenre, subgenre_family, format, price)")
def game_item_fields(spark, sf_dir):
    rows = _metadata(spark, [r for r, _ in _GAMES])
    return rows.select(F.col("parent_asin").alias("id"), it.game_fields(F.col("title"), F.col("categories"), F.col("price")).alias("f")).select("id", "f.*")


_MOVIES = [
    ({"title": "The Quiet Coast", "categories": ["Movies & TV", "Drama", "Family Life"], "store": "Someone  Format: Blu-ray", "price": "$7"}, "The Quiet Coast", "Drama", "Family Life", "", "Blu-ray", 7.0, None),
    ({"title": "Red Valley (VHS)", "categories": ["Movies & TV", "Movies", "Western"], "price": None}, "Red Valley (VHS)", "Western", "", "", "VHS Tape", None, "movie"),
    ({"title": "Hill Road Season 3", "categories": ["TV", "Kids", "Anime & Manga", "Robots"], "main_category": "Prime Video"}, "Hill Road Season 3", "Kids & Family|Animation", "Robots", "Anime & Manga", "Prime Video", None, "tv"),
    ({"title": "Deep  Water", "categories": ["Horror", "Today's Deals"], "details": {"Media Format": "NTSC, DVD", "Run time": "1 hour and 31 minutes"}}, "Deep Water", "Horror", "", "", "DVD", None, "movie"),
    ({"title": "Both Season 1", "categories": ["Movies"], "details": {"Runtime": "2 hours"}}, "Both Season 1", "", "", "", "", None, None),
    ({"title": "Ten Winter Tales", "categories": [], "details": {"Runtime": "9 hours 20 min"}}, "Ten Winter Tales", "", "", "", "", None, "tv"),
    ({"title": "Winter Trilogy", "categories": [], "details": {"Runtime": "6 hours"}}, "Winter Trilogy", "", "", "", "", None, None),
    ({"title": "A Short Clip", "categories": None, "details": {"Runtime": "12 min"}}, "A Short Clip", "", "", "", "", None, None),
]


@query(f"SELECT id, title, genres, subgenre, subgenre_family, format, price::DOUBLE AS price, media FROM ({_values([(f'A{i}', *w) for i, (_, *w) in enumerate(_MOVIES)])}) v(id, title, genres, subgenre, subgenre_family, format, price, media)")
def movie_item_fields(spark, sf_dir):
    rows = _metadata(spark, [r[0] for r in _MOVIES])
    own = domains.movie_items(rows).join(domains.kind_of(rows).select("parent_asin", "media"), "parent_asin")
    return own.select(F.col("parent_asin").alias("id"), "title", F.array_join("genres", "|").alias("genres"), "subgenre", "subgenre_family", "format", "price", "media")


_MEDIA = [
    ({"title": "Salt and Stone", "categories": ["Books", "Literature & Fiction", "Sea Stories", "Islands"], "author": ("Mara  Lind",), "details": {"Paperback": "210 pages"}, "price": "$11.50"}, "Salt and Stone by Mara Lind", "Literature & Fiction", "Islands", "Sea Stories", "Paperback", 11.5),
    ({"title": "Plain Songs", "categories": ["CDs & Vinyl", "Dance & DJ", "General"], "store": "Ola Berg (Singer), Others (Choir)    Format: Vinyl"}, "Plain Songs by Ola Berg", "", "", "", "Vinyl", None),
    ({"title": "No Name", "categories": ["Books", "Travel"], "store": "Various", "main_category": "Buy a Kindle", "details": {"File size": "2 MB"}}, "No Name", "Travel", "", "", "Kindle Edition", None),
    ({"title": "File Only", "categories": ["Books"], "author": ("Rated: G",), "details": {"File size": "2 MB"}}, "File Only", "", "", "", "Kindle Edition", None),
    ({"title": "Heard", "categories": ["Books", "Boxed Sets", "History"], "main_category": "Audible Audiobooks"}, "Heard", "History", "", "", "Audiobook", None),
]


@query(f"SELECT id, title, genres, subgenre, subgenre_family, format, price::DOUBLE AS price FROM ({_values([(f'A{i}', *w) for i, (_, *w) in enumerate(_MEDIA)])}) v(id, title, genres, subgenre, subgenre_family, format, price)")
def media_item_fields(spark, sf_dir):
    own = domains.media_items(_metadata(spark, [r[0] for r in _MEDIA]), it.BOOKS)
    return own.select(F.col("parent_asin").alias("id"), "title", F.array_join("genres", "|").alias("genres"), "subgenre", "subgenre_family", "format", "price")


_LABELS = sorted({*it.MOVIE_GENRES, *it.MUSIC_GENRES, *it.BOOK_GENRES, "Blu-ray", "Cerebral"})


@query("SELECT label, movie, music, book FROM (" + _values([(x, it.MOVIE_GENRES.get(x), it.MUSIC_GENRES.get(x), it.BOOK_GENRES.get(x)) for x in _LABELS]) + ") v(label, movie, music, book)")
def genre_labels(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in _LABELS], "label string")
    path = F.array(F.lit("root"), F.col("label"))
    return rows.select("label", F.get(it.movie_genres(F.array("label")), F.lit(0)).alias("movie"), F.get(it.media_genre(path, it.MUSIC_GENRES), F.lit(0)).alias("music"), F.get(it.media_genre(path, it.BOOK_GENRES), F.lit(0)).alias("book"))


# Subsets and units ---------------------------------------------------------------------------------------------------

_SHARE, _LEAST = 0.6, 5


def _subset(spark, sf_dir):
    rows = src.interactions(spark, sf_dir)
    raw = rows.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"), F.concat(F.lit("P"), F.col("item_id").cast("string")).alias("parent_asin"), "rating", (F.col("timestamp") * 1000).alias("timestamp"))
    items = src.items(spark, sf_dir).where(F.col("title").contains("ing")).select(F.concat(F.lit("P"), F.col("item_id").cast("string")).alias("parent_asin"), "title", "genres")
    return domains.subset(raw, items, _SHARE, 3, _LEAST)


def _subset_sql(rounds: int = 10) -> dict[str, str]:
    parts = {"cor_0": f"SELECT 'U' || user_id AS user_id, 'P' || item_id AS parent_asin, rating, timestamp * 1000 AS timestamp FROM inter WHERE item_id IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ing%') AND {u('3', repr('U') + ' || user_id')} < {_SHARE} * 4294967296"}
    for i in range(1, rounds + 1):
        parts[f"hal_{i}"] = f"SELECT * FROM cor_{i - 1} WHERE parent_asin IN (SELECT parent_asin FROM cor_{i - 1} GROUP BY parent_asin HAVING count(*) >= {_LEAST})"
        parts[f"cor_{i}"] = f"SELECT * FROM hal_{i} WHERE user_id IN (SELECT user_id FROM hal_{i} GROUP BY user_id HAVING count(*) >= {_LEAST})"
    return parts | {"cor": f"SELECT * FROM cor_{rounds}"}


@query(sql("""SELECT count(*) AS ratings, count(DISTINCT user_id) AS users, count(DISTINCT parent_asin) AS items, count(DISTINCT parent_asin) AS items_with_genre,
  (SELECT round(avg((gap = 0)::INT), 4) FROM gps) AS same_second, (SELECT round(avg((gap > 86400)::INT), 4) FROM gps) AS over_a_day FROM cor""",
  **_subset_sql(), gps="SELECT * FROM (SELECT (timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, parent_asin)) / 1000 AS gap FROM cor) WHERE gap IS NOT NULL"))
def subset_report(spark, sf_dir):
    return domains.subset_summary(*_subset(spark, sf_dir))


@query(sql("SELECT count(*) AS rows, sum(('0x' || substr(sha256(concat_ws(',', user_id, parent_asin, rating::VARCHAR, timestamp::VARCHAR)), 1, 15))::HUGEINT)::VARCHAR AS digest FROM cor", **_subset_sql()))
def subset_fingerprint(spark, sf_dir):
    return domains.fingerprint(_subset(spark, sf_dir)[0])


@query(sql("SELECT pool_type, session_id, (row_number() OVER (ORDER BY pool_type, session_id) - 1) // 25 AS unit FROM (SELECT DISTINCT session_id, 'random' AS pool_type FROM rand)"))
def work_units(spark, sf_dir):
    return domains.units(Bench(spark, sf_dir).random())


@query(sql(f"SELECT session_id, k FROM (SELECT session_id, row_number() OVER (ORDER BY {order('0', 'session_id')}) AS k FROM clean) WHERE k <= 50"))
def sampled_sessions(spark, sf_dir):
    """A top-k by hash order: the sampling operator of a run."""
    return trials.sampled(Bench(spark, sf_dir).clean.select("session_id"), 50)


# Single-prompt runs --------------------------------------------------------------------------------------------------

_MEMBER = trials.MEMBERS[0]
#: A response is read in presented order, which breaks ties.
_SHOWN = {"pool": "SELECT * FROM rand", "shown_rank": f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, slot) AS rank FROM answers WHERE member = '{_MEMBER}'"}


def _single(b: Bench):
    """Records of one member's run in which some requests failed and some answers are spoiled."""
    k = F.pmod(uniform_hash(F.lit("single"), F.col("session_id")), F.lit(20))
    rows = trials.responses(b.answers().where(F.col("member") == _MEMBER))
    rows = rows.withColumn("response", F.when(k == 0, None).when(k == 1, "no answer").otherwise(F.col("response")))
    return trials.single_records(trials.parsed(rows), b.clean)


@query(sql(f"""SELECT trial_id, CASE WHEN k > 1 THEN rank END AS target_rank, k > 1 AS parse_success, k > 0 AS request_success FROM (
  SELECT session_id || '::direct::title' AS trial_id, rank, {u(repr('single'), 'session_id')} % 20 AS k FROM shown_rank WHERE item_id = target)""", **_SHOWN))
def single_records(spark, sf_dir):
    return _single(Bench(spark, sf_dir)).select("trial_id", "target_rank", "parse_success", "request_success")


@query(sql("SELECT s.*, f.parse_failures, f.request_failures FROM (" + _summary("(SELECT member, CASE WHEN k > 1 THEN rank END AS rank FROM sgl)", "member") + ") s JOIN (SELECT member, count(*) FILTER (k = 1) AS parse_failures, count(*) FILTER (k = 0) AS request_failures FROM sgl GROUP BY member) f USING (member)",
  **_SHOWN, sgl=f"SELECT member, rank, {u(repr('single'), 'session_id')} % 20 AS k FROM shown_rank WHERE item_id = target"))
def single_evaluation(spark, sf_dir):
    rows = _single(Bench(spark, sf_dir))
    return trials.single_evaluation(rows)


# Power ---------------------------------------------------------------------------------------------------------------

_PLANNED, _ALPHA, _POWER = 3_000, 0.05, 0.8
_ZA, _ZP = NormalDist().inv_cdf(1 - _ALPHA / 2), NormalDist().inv_cdf(_POWER)
_TWO = "CASE WHEN {x} = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum([exp(2 * k * ln(2) + (2 * k + 1) * ln({x}) + lgamma(k + 1) - lgamma(2 * k + 2)) FOR k IN range(0, 161)])) END"
_POWER_PAIRS = [p for p in records.COMPARISONS[:5] if p[0] != "long_tail_weighted" or p[1] == "reliability_weighted"]


@query(sql(f"""SELECT comparison, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(d, 6) AS effect, improved, worsened, tied, needed, needed_at_bound, round(power, 6) AS power,
  CASE WHEN needed IS NULL THEN 'no effect in pilot; a full run would only confirm a null result' WHEN needed <= {_PLANNED} THEN 'worth it: {_PLANNED} sessions give ' || printf('%.0f', power * 100) || '% power (need ' || needed || ')'
    ELSE 'underpowered: {_PLANNED} sessions give ' || printf('%.0f', power * 100) || '% power; need ' || needed END AS verdict FROM (
  SELECT *, CASE WHEN d <> 0 THEN ceil((({_ZA!r} + {_ZP!r}) / abs(d)) ** 2 / 0.864)::BIGINT END AS needed, CASE WHEN bound <> 0 THEN ceil((({_ZA!r} + {_ZP!r}) / abs(bound)) ** 2 / 0.864)::BIGINT END AS needed_at_bound,
    CASE WHEN shift >= {_ZA!r} THEN 1 - ({_TWO.format(x='x1')}) / 2 ELSE ({_TWO.format(x='x1')}) / 2 END + ({_TWO.format(x='x2')}) / 2 AS power FROM (
  SELECT *, least(abs(shift - {_ZA!r}), 8.0) / sqrt(2) AS x1, least(shift + {_ZA!r}, 8.0) / sqrt(2) AS x2 FROM (
  SELECT *, abs(d) * sqrt({_PLANNED} * 0.864) AS shift, CASE WHEN edge * mean > 0 THEN round(edge / sd, 9) ELSE 0 END AS bound FROM (
  SELECT e.*, round(coalesce(mean / nullif(sd, 0), 0), 9) AS d, CASE WHEN mean > 0 THEN low ELSE high END AS edge FROM (
    SELECT comparison, count(*) AS n, avg(a - b) AS mean, stddev_samp(a - b) AS sd, count(*) FILTER (a > b) AS improved, count(*) FILTER (a < b) AS worsened, count(*) FILTER (a = b) AS tied FROM prs GROUP BY comparison) e JOIN bot USING (comparison)))))""",
  **_OUT, **_tests(" UNION ALL ".join(f"SELECT '{a}_vs_{b}' AS comparison, session_id, 1 / {records_name[a]} AS a, 1 / {records_name[b]} AS b FROM base_o" for records_name in ({"single_prompt_baseline": "single", "naive_mean_ensemble": "naive_mean", "reliability_weighted": "reliability_weighted", "long_tail_weighted": "long_tail_weighted"},) for a, b in _POWER_PAIRS))))
def power_report(spark, sf_dir):
    return st.power_report(records.paired(Trials(spark, sf_dir).outcomes(), _POWER_PAIRS), _PLANNED, _ALPHA, _POWER)
