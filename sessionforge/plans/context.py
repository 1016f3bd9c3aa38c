"""Queries of the context renderers and of the prompt texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx
from ..operators import prompts as pr
from ..operators.sessions import exploded
from ..sources import tables as src
from .oracle import sql
from .registry import Bench, query

_POOL = {"pool": "SELECT * FROM rand"}

#: Common table expressions of the contexts: what is shown, and the statistics of items.
_CTX = _POOL | {
    "shown": "SELECT DISTINCT session_id, 'history' AS side, past AS item_id FROM h50 UNION ALL SELECT session_id, 'candidate', item_id FROM pool",
    "stems": r"""SELECT item_id, title, lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_split_to_array(regexp_replace(regexp_replace(title, '\([0-9]{4}\)\s*$', ''),
      '\[.*?\]|\(.*?\)', '', 'g'), ':| - ')[1]), ',\s*(the|a|an)\s*$', '', 'i')), '\s+([0-9]+|ii|iii|iv|v|vi)\s*$', '', 'i'), '\s+', ' ', 'g'))) AS stem FROM itm""",
    "stem_n": r"SELECT stem, trim(regexp_split_to_array(regexp_replace(min_by(title, item_id), '\([0-9]{4}\)\s*$', ''), ':| - ')[1]) AS series FROM stems WHERE stem <> '' GROUP BY stem HAVING count(*) >= 2",
    "cont": """SELECT item_id, 'genres=' || array_to_string(genres[1:3], ', ') || '; series=' || coalesce(series, 'none') || '; first_seen=' || coalesce(year(to_timestamp(first_seen))::VARCHAR, 'unknown') AS fields
      FROM stems JOIN itm USING (item_id) LEFT JOIN stem_n USING (stem) LEFT JOIN seen USING (item_id)""",
    "aud": "SELECT item_id, CASE WHEN n <= a THEN 'niche' WHEN n <= b THEN 'moderate' ELSE 'popular' END AS audience FROM pop, (SELECT quantile_cont(n, 1/3) AS a, quantile_cont(n, 2/3) AS b FROM pop)",
    "cutoff": "SELECT quantile_cont(timestamp, 0.75) AS cut FROM train",
    "late": "SELECT avg((timestamp >= cut)::INT) AS total FROM train, cutoff",
    "trd": """SELECT item_id, CASE WHEN n < 5 THEN 'n/a' WHEN r > 1.5 THEN 'rising' WHEN r < 0.5 THEN 'falling' ELSE 'steady' END AS trend FROM (
      SELECT item_id, count(*) AS n, round(avg((timestamp >= cut)::INT) / any_value(total), 9) AS r FROM train, cutoff, late GROUP BY item_id)""",
    "mean": "SELECT item_id, printf('%.1f', avg(rating)) || '/5' AS rating FROM train GROUP BY item_id",
    "crow": "SELECT i.item_id, 'avg_rating=' || coalesce(rating, 'n/a') || '; audience=' || coalesce(audience, 'unseen') || '; trend=' || coalesce(trend, 'n/a') AS fields FROM itm i LEFT JOIN mean USING (item_id) LEFT JOIN aud USING (item_id) LEFT JOIN trd USING (item_id)",
    "meta": "SELECT p_partkey AS item_id, p_brand AS subgenre, p_type AS family, CASE WHEN p_size <= 15 THEN 'compact' WHEN p_size <= 35 THEN 'standard' ELSE '' END AS format, p_retailprice AS price FROM part WHERE p_partkey IN (SELECT item_id FROM inter)",
    "tiers": "SELECT quantile_cont(price, 1/3) AS a, quantile_cont(price, 2/3) AS b FROM meta WHERE price > 0",
    "buy": """SELECT item_id, 'format=' || coalesce(nullif(format, ''), 'unknown') || '; price=' || CASE WHEN price > 0 THEN printf('$%.2f', price) ELSE 'unknown' END || '; price_level='
      || CASE WHEN price > 0 THEN CASE WHEN price <= a THEN 'low' WHEN price <= b THEN 'mid' ELSE 'high' END ELSE 'unknown' END AS fields FROM meta, tiers""",
    "f_content": "SELECT session_id, side, item_id, fields FROM shown JOIN cont USING (item_id)",
    "f_crowd": "SELECT session_id, side, item_id, fields FROM shown JOIN crow USING (item_id)",
    "f_format": "SELECT session_id, side, item_id, fields FROM shown JOIN buy USING (item_id)",
    "taste": """SELECT session_id, list(g) AS top FROM (SELECT session_id, g, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(-back * 100 + k)) AS r FROM (
      SELECT session_id, back, unnest(genres) AS g, unnest(range(1, len(genres) + 1)) AS k FROM h50 JOIN itm ON itm.item_id = past) GROUP BY session_id, g) WHERE r <= 3 GROUP BY session_id""",
    "own": "SELECT 'user-' || user_id AS session_id, item_id, max_by(rating, seq) AS score FROM train GROUP BY ALL",
    "agos": "SELECT session_id, past AS item_id, max(back) + 1 AS place FROM h50 GROUP BY ALL",
    "f_personal": """SELECT session_id, side, item_id, 'your_rating=' || CASE WHEN side = 'candidate' THEN 'not rated' WHEN score IS NULL THEN 'unknown'
      ELSE CASE WHEN score >= 4 THEN 'liked' WHEN score <= 2 THEN 'disliked' ELSE 'neutral' END || ' (' || score::BIGINT || '/5)' END || '; recency='
      || CASE WHEN side = 'candidate' THEN 'new' WHEN place = 1 THEN 'most recent' WHEN place = 2 THEN '2nd most recent' WHEN place = 3 THEN '3rd most recent' ELSE place || 'th most recent' END
      || '; matches_you=' || coalesce(nullif(array_to_string([g FOR g IN genres IF list_contains(top, g)], ', '), ''), 'none') AS fields
      FROM shown JOIN itm USING (item_id) LEFT JOIN taste USING (session_id) LEFT JOIN own USING (session_id, item_id) LEFT JOIN agos USING (session_id, item_id)""",
    "lens": "SELECT session_id, least(50, len(prefix)) AS size FROM clean",
    "subs": "SELECT session_id, subgenre, count(*) AS n FROM h50 JOIN meta ON meta.item_id = past GROUP BY ALL",
    "f_subgenre": """SELECT session_id, side, item_id, 'subgenre=' || coalesce(subgenre, 'none') || '; family=' || coalesce(family, 'none') || '; in_your_history='
      || (coalesce(n, 0) - CASE WHEN side = 'history' THEN 1 ELSE 0 END) || ' of your last ' || size AS fields FROM shown JOIN meta USING (item_id) LEFT JOIN subs USING (session_id, subgenre) JOIN lens USING (session_id)""",
    "pair": "SELECT a.item_id AS past, b.item_id, count(*) AS co FROM edges a JOIN edges b USING (user_id) GROUP BY ALL",
    "near": """SELECT session_id, item_id, max(cosine) AS cosine, max_by(past, {'c': cosine, 'b': back}) AS past FROM (
      SELECT p.session_id, p.item_id, h.past, h.back, round(co / (x.norm * y.norm), 9) AS cosine FROM pool p JOIN h50 h USING (session_id) JOIN pair ON pair.past = h.past AND pair.item_id = p.item_id
      JOIN norms x ON x.item_id = h.past JOIN norms y ON y.item_id = p.item_id) GROUP BY ALL""",
    "ranks": "SELECT session_id, item_id, past, row_number() OVER (PARTITION BY session_id ORDER BY cosine DESC, item_id DESC) AS r FROM near",
    "foll": "SELECT session_id, p.item_id, max_by(h.past, {'n': n, 'b': back}) AS after FROM pool p JOIN h5 h USING (session_id) JOIN trans t ON t.previous = h.past AND t.next = p.item_id GROUP BY ALL",
    "f_collab": """SELECT p.session_id, 'candidate' AS side, p.item_id, 'co_chosen_with=' || coalesce(a.title, 'none') || '; link=' || CASE WHEN r <= 5 THEN 'strong' WHEN r <= 10 THEN 'medium' WHEN r IS NOT NULL THEN 'weak' ELSE 'none' END
      || '; follows=' || coalesce(b.title, 'none') AS fields FROM pool p LEFT JOIN ranks k ON k.session_id = p.session_id AND k.item_id = p.item_id LEFT JOIN itm a ON a.item_id = k.past
      LEFT JOIN foll f ON f.session_id = p.session_id AND f.item_id = p.item_id LEFT JOIN itm b ON b.item_id = f.after""",
}


class Shown(Bench):
    """Sessions with the candidates of their random pools, and the features of items."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        pool = self.random().groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "item_id"))), lambda x: x["item_id"]).alias("candidates"))
        self.sessions = self.kept("shown", lambda: self.clean.select("session_id", "user_id", "prefix").join(exploded(pool), "session_id"))

    def features(self):
        return self.kept("features", lambda: cx.item_features(self.train, self.pop, self.items, src.item_meta(self.spark, self.sf_dir).join(exploded(self.items.select("item_id")), "item_id", "left_semi")))

    def fields(self, variant: str):
        return cx.fields(variant, self.sessions, self.features(), self.train)


def _renderer(name: str) -> None:
    def run(spark, sf_dir):
        return Shown(spark, sf_dir).fields(f"context_{name}_v2")

    run.__name__ = f"context_{name}"
    query(sql(f"SELECT session_id, side, item_id, fields FROM f_{name}", **_CTX))(run)


for _name in ("content", "crowd", "personal", "collab", "subgenre", "format"):
    _renderer(_name)


@query(sql("SELECT item_id, coalesce(series, 'none') AS series FROM stems LEFT JOIN stem_n USING (stem)", **_CTX))
def item_series(spark, sf_dir):
    return cx.series(Bench(spark, sf_dir).items)


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt_sql(context: str, variants: list[str]) -> str:
    """The same texts from the same fixed values: templates with lists and numbers put in by replace()."""
    name = context.split("_")[1]
    evidence = pr.FIELDS_EVIDENCE if context in pr.FIELD_CONTEXTS else pr.TITLES_EVIDENCE
    more = {"title": "''", "genre": "'; genres=' || array_to_string(genres, '|')", "rich": "'; genres=' || array_to_string(genres, '|') || '; release_year=unknown'"}.get(name, "coalesce('; ' || fields, '')")
    fields = f"LEFT JOIN f_{name} f ON f.session_id = l.session_id AND f.side = l.side AND f.item_id = l.item_id" if context in pr.FIELD_CONTEXTS else ""
    values = ", ".join(f"({_lit(v)}, {_lit((pr.OPENING + '<H>' + pr.AFTER_HISTORY + '<C>' + pr.RULES).replace('{context}', pr.CONTEXTS[context]).replace('{instructions}', chr(10).join(pr.INSTRUCTIONS[v])).replace('{evidence}', evidence).replace('{noun}', 'item'))})" for v in variants)
    return f"""SELECT t.session_id, variant_id, '{context}' AS context_variant_id, {_lit(pr.SYSTEM.replace('{noun}', 'item'))} AS system_message,
      replace(replace(replace(body, '{{n}}', '20'), '<H>', h), '<C>', c) AS user_message FROM (
      SELECT l.session_id, string_agg(line, chr(10) ORDER BY i) FILTER (l.side = 'history') AS h, string_agg(line, chr(10) ORDER BY i) FILTER (l.side = 'candidate') AS c FROM (
        SELECT l.session_id, l.side, l.i, l.i || '. title=' || title || {more} AS line FROM (
          SELECT session_id, 'history' AS side, unnest(prefix) AS item_id, unnest(range(1, len(prefix) + 1)) AS i FROM clean
          UNION ALL SELECT session_id, 'candidate', item_id, position + 1 FROM pool) l JOIN itm ON itm.item_id = l.item_id {fields}) l GROUP BY l.session_id) t, (VALUES {values}) v(variant_id, body)"""


def _prompts(name: str, context: str, variants: list[str]) -> None:
    def run(spark, sf_dir):
        b = Shown(spark, sf_dir)
        fields = b.fields(context) if context in pr.FIELD_CONTEXTS else None
        return pr.prompts(b.sessions, b.items, variants, context, "item", fields)

    run.__name__ = name
    query(sql(_prompt_sql(context, variants), **_CTX))(run)


_prompts("prompts_all_variants", "context_title_v1", list(pr.INSTRUCTIONS))
for _context in list(pr.CONTEXTS)[1:]:
    _prompts(f"prompts_{_context.split('_')[1]}", _context, pr.STRATEGY_SET[:2])
