"""DuckDB SQL of the registered queries, put together from named common table expressions."""

from __future__ import annotations

import re

U = "('0x' || substr(sha256(concat_ws(':', {})), 1, 8))::BIGINT"


def u(*parts: str) -> str:
    return U.format(", ".join(f"({p})::VARCHAR" for p in parts))


def order(*parts: str) -> str:
    return "sha256(concat_ws(':', {}))".format(", ".join(f"({p})::VARCHAR" for p in parts))


TIES = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"
GROUP = "array_to_string(list_sort(genres), '|')"


def _matched(asked: str, groups: str, label: str) -> str:
    """Negatives near the target's place: asked (session_id, prefix, target, grp), groups (grp, item_id, place)."""
    return f"""SELECT session_id, item_id FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, below ORDER BY {order('0', f"'{label}'", "'draw'", 'session_id', 'item_id')}, item_id) AS pick FROM (
        SELECT *, CASE WHEN below THEN k2 ELSE 19 - k2 END AS cnt FROM (
          SELECT *, CASE WHEN has_below < k THEN has_below WHEN has_above < 19 - k THEN 19 - has_above ELSE k END AS k2 FROM (
            SELECT *, least(57, count(*) FILTER (below) OVER (PARTITION BY session_id)) AS has_below, least(57, count(*) FILTER (NOT below) OVER (PARTITION BY session_id)) AS has_above,
              row_number() OVER (PARTITION BY session_id, below ORDER BY abs(place - spot)) AS near FROM (
              SELECT a.session_id, g.item_id, g.place, t.place AS spot, g.place < t.place AS below, {u('0', f"'{label}'", 'a.session_id')} % 20 AS k
              FROM {asked} a JOIN {groups} t ON t.grp = a.grp AND t.item_id = a.target JOIN {groups} g ON g.grp = a.grp AND g.place <> t.place
              WHERE NOT list_contains(a.prefix, g.item_id))))
        WHERE k2 >= 0 AND has_below >= k2 AND has_above >= 19 - k2)
      WHERE near <= greatest(3 * cnt, 30)) WHERE pick <= cnt"""


def _pool(negatives: str, label: str) -> str:
    """Pools with positions from negatives and the targets of their sessions."""
    return f"""SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {order('0', f"'{label}'", "'order'", 'session_id', 'item_id')}, item_id) - 1 AS position FROM (
      SELECT n.session_id, c.split, c.target, n.item_id FROM {negatives} n JOIN clean c USING (session_id)
      UNION ALL SELECT session_id, split, target, target FROM clean WHERE session_id IN (SELECT session_id FROM {negatives}))"""


def _history(n: int) -> str:
    return f"SELECT session_id, prefix[len(prefix) - b] AS past, b AS back FROM (SELECT session_id, prefix, unnest(range(0, least({n}, len(prefix)))) AS b FROM clean)"


PARTS = {
    "inter": f"SELECT o_custkey AS user_id, l_partkey AS item_id, epoch(l_shipdate)::BIGINT AS timestamp, (1 + floor((l_quantity - 1) / 10))::DOUBLE AS rating, {TIES} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "hist": f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id, {TIES}) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM inter",
    "train": "SELECT * FROM hist WHERE seq < n",
    "ex": """SELECT user_id, 'user-' || user_id AS session_id, any_value(n) AS n, coalesce(list(item_id ORDER BY seq) FILTER (seq < n), []) AS prefix, max(item_id) FILTER (seq = n) AS target,
      max(timestamp) FILTER (seq = n) AS target_timestamp, max(timestamp) FILTER (seq = n - 1) AS before_timestamp, max(rating) FILTER (seq = n) AS target_rating FROM hist GROUP BY user_id""",
    "judged": """SELECT *, CASE WHEN n <= 3 THEN 'short' WHEN target_rating < 4 THEN 'non_positive' WHEN target_timestamp = before_timestamp THEN 'tied'
      WHEN list_contains(prefix, target) THEN 'in_history' END AS drop_reason FROM ex""",
    "clean": f"SELECT user_id, session_id, prefix, target, target_timestamp, CASE WHEN {u('0', 'session_id')} < 0.3 * 4294967296 THEN 'validation' ELSE 'test' END AS split FROM judged WHERE drop_reason IS NULL",
    "pop": "SELECT item_id, count(*) AS n FROM train GROUP BY item_id",
    "seen": "SELECT item_id, min(timestamp) AS first_seen FROM train GROUP BY item_id",
    "itm": "SELECT p_partkey AS item_id, p_name AS title, CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END AS genres, p_retailprice AS price FROM part WHERE p_partkey IN (SELECT item_id FROM inter)",
    "trans": f"SELECT previous, next, count(*) AS n FROM (SELECT item_id AS previous, lead(item_id) OVER (PARTITION BY user_id ORDER BY timestamp, item_id, {TIES}) AS next FROM train) WHERE next IS NOT NULL GROUP BY ALL",
    "edges": "SELECT DISTINCT user_id, item_id FROM train WHERE item_id IN (SELECT item_id FROM itm)",
    "norms": "SELECT item_id, sqrt(count(*)) AS norm FROM edges GROUP BY item_id",
    "listed": "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS number FROM itm",
    "rand_d": f"""SELECT session_id, item_id FROM (SELECT session_id, item_id, row_number() OVER (PARTITION BY session_id ORDER BY draw) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM (
      SELECT d.session_id, l.item_id, min(draw) AS draw FROM (SELECT *, {u('0', "'random'", 'session_id', 'draw')} % (SELECT count(*) FROM listed) AS number
        FROM (SELECT session_id, prefix, target, unnest(range(0, 81 + 4 * len(prefix))) AS draw FROM clean)) d JOIN listed l ON l.number = d.number
      WHERE NOT list_contains(d.prefix, l.item_id) AND l.item_id <> d.target GROUP BY ALL)) WHERE r < 20 AND n >= 19""",
    "rand_n": f"""SELECT * FROM rand_d UNION ALL SELECT session_id, item_id FROM (
      SELECT c.session_id, i.item_id, row_number() OVER (PARTITION BY c.session_id ORDER BY {order('0', "'random'", "'rest'", 'c.session_id', 'i.item_id')}, i.item_id) AS r
      FROM clean c CROSS JOIN itm i WHERE c.session_id NOT IN (SELECT session_id FROM rand_d) AND NOT list_contains(c.prefix, i.item_id) AND i.item_id <> c.target) WHERE r < 20""",
    "rand": _pool("rand_n", "random"),
    "base": f"SELECT i.item_id, i.genres, coalesce(p.n, 0) AS n, coalesce(s.first_seen, 4611686018427387904) AS seen, {order('0', 'i.item_id')} AS tie FROM itm i LEFT JOIN pop p USING (item_id) LEFT JOIN seen s USING (item_id)",
    "all_g": "SELECT '' AS grp, item_id, n, row_number() OVER (ORDER BY n, tie, item_id) - 1 AS place FROM base",
    "kinds": f"SELECT DISTINCT {GROUP} AS grp, genres FROM itm",
    "member": "SELECT DISTINCT k.grp, b.item_id, b.n, b.seen, b.tie FROM kinds k JOIN base b ON list_has_any(k.genres, b.genres)",
    "attr_g": "SELECT grp, item_id, n, row_number() OVER (PARTITION BY grp ORDER BY n, tie, item_id) - 1 AS place FROM member",
    "ask_all": "SELECT session_id, prefix, target, '' AS grp FROM clean",
    "ask_attr": f"SELECT c.session_id, c.prefix, c.target, {GROUP} AS grp FROM clean c JOIN itm i ON i.item_id = c.target",
    "match_n": _matched("ask_all", "all_g", "matched"),
    "match": _pool("match_n", "popularity_matched"),
    "attr_1": _matched("ask_attr", "attr_g", "attribute_matched"),
    "ask_rest": "SELECT * FROM ask_all WHERE session_id NOT IN (SELECT session_id FROM attr_1)",
    "attr_2": _matched("ask_rest", "all_g", "attribute_matched:fallback"),
    "attr_n": "SELECT * FROM attr_1 UNION ALL SELECT * FROM attr_2",
    "attr": _pool("attr_n", "attribute_matched"),
    "rec_m": """SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n, tie, item_id) AS r1, row_number() OVER (PARTITION BY grp ORDER BY seen, tie, item_id) AS r2 FROM (
      SELECT grp, item_id, n, seen, tie FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS size FROM member) WHERE size > 38 UNION ALL SELECT '', item_id, n, seen, tie FROM base)""",
    "rec_rows": f"""SELECT o.session_id, o.k1, o.k2, m.item_id, m.tie, m.r1, m.r2, o.t1, o.t2, m.r1 < o.t1 AS b1, m.r2 < o.t2 AS b2 FROM (
      SELECT a.session_id, a.prefix, t.grp, t.n AS tn, t.r1 AS t1, t.r2 AS t2, {u('0', "'recency:1'", 'a.session_id')} % 20 AS k1, {u('0', "'recency:2'", 'a.session_id')} % 20 AS k2
      FROM ask_attr a JOIN rec_m t ON t.item_id = a.target AND t.grp = CASE WHEN a.grp IN (SELECT grp FROM rec_m) THEN a.grp ELSE '' END) o
      JOIN rec_m m ON m.grp = o.grp WHERE m.n <> o.tn AND NOT list_contains(o.prefix, m.item_id)""",
    "rec_a": f"""SELECT session_id, low + {u('0', "'recency:a'", 'session_id')} % (high - low + 1) AS a FROM (
      SELECT *, greatest(0, k1 + k2 - 19, k1 - tf, k2 - ft) AS low, least(k1, k2, tt, ff - 19 + k1 + k2) AS high FROM (
        SELECT session_id, k1, k2, count(*) FILTER (b1 AND b2) AS tt, count(*) FILTER (b1 AND NOT b2) AS tf, count(*) FILTER (NOT b1 AND b2) AS ft, count(*) FILTER (NOT b1 AND NOT b2) AS ff FROM rec_rows GROUP BY ALL)
      WHERE tt + tf >= 19 AND ft + ff >= 19 AND tt + ft >= 19 AND tf + ff >= 19) WHERE low <= high""",
    "rec_n": f"""SELECT session_id, item_id FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, b1, b2 ORDER BY {order('0', "'recency:draw'", 'session_id', 'item_id')}, item_id) AS pick FROM (
        SELECT r.*, CASE WHEN b1 AND b2 THEN a WHEN b1 THEN k1 - a WHEN b2 THEN k2 - a ELSE 19 - k1 - k2 + a END AS cnt,
          row_number() OVER (PARTITION BY session_id, b1, b2 ORDER BY abs(r1 - t1) + abs(r2 - t2), tie, item_id) AS near FROM rec_rows r JOIN rec_a USING (session_id))
      WHERE near <= greatest(3 * cnt, 30)) WHERE pick <= cnt""",
    "rec": _pool("rec_n", "recency_matched"),
    "popular": """SELECT session_id, split, target, number % 20 AS spot, [i FOR i IN head IF NOT list_contains(prefix, i) AND i <> target][1:19] AS neg FROM (
      SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS number FROM clean), (SELECT list(item_id ORDER BY n DESC, item_id) AS head FROM pop)""",
    "top": "SELECT session_id, split, target, unnest(list_concat(neg[1:spot], [target], neg[spot + 1:19])) AS item_id, unnest(range(0, 20)) AS position FROM popular",
    "h20": _history(20),
    "h50": _history(50),
    "h5": _history(5),
    "co": "SELECT a.item_id AS past, b.item_id, count(*) AS co FROM edges a JOIN edges b USING (user_id) WHERE a.item_id IN (SELECT past FROM h20) GROUP BY ALL",
    "cosine": "SELECT past, c.item_id, co / (x.norm * y.norm) AS cosine FROM co c JOIN norms x ON x.item_id = c.past JOIN norms y ON y.item_id = c.item_id",
    "ret": """SELECT session_id, item_id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, n DESC, item_id) AS r FROM (
      SELECT c.session_id, i.item_id, coalesce(s.score, 0) AS score, coalesce(p.n, 0) AS n FROM clean c CROSS JOIN itm i
      LEFT JOIN (SELECT session_id, item_id, round(sum(cosine), 9) AS score FROM h20 JOIN cosine USING (past) GROUP BY ALL) s ON s.session_id = c.session_id AND s.item_id = i.item_id
      LEFT JOIN pop p ON p.item_id = i.item_id WHERE NOT list_contains(c.prefix, i.item_id))) WHERE r <= 20""",
    "ret_n": """SELECT r.session_id, c.split, c.target, CASE WHEN f.found = 0 AND r.r = 20 THEN c.target ELSE r.item_id END AS item_id, f.found = 1 AS target_retrieved
      FROM ret r JOIN clean c USING (session_id) JOIN (SELECT session_id, max((item_id = target)::INT) AS found FROM ret JOIN clean USING (session_id) GROUP BY session_id) f USING (session_id)""",
    "tok": r"""SELECT item_id, list_distinct([w FOR w IN regexp_extract_all(regexp_replace(lower(title), '\([0-9]{4}\)', '', 'g'), '[a-z0-9]+') IF len(w) > 1 AND NOT list_contains(
      ['the','a','an','of','and','for','with','to','in','on','edition','game','games','video','by'], w)]) AS words FROM itm""",
    "scores": """SELECT p.session_id, p.item_id, 'random' AS ranker, 0::DOUBLE AS score FROM pool p
      UNION ALL SELECT p.session_id, p.item_id, 'popularity', coalesce(n, 0)::DOUBLE FROM pool p LEFT JOIN pop USING (item_id)
      UNION ALL SELECT p.session_id, p.item_id, 'inverse_popularity', -coalesce(n, 0)::DOUBLE FROM pool p LEFT JOIN pop USING (item_id)
      UNION ALL SELECT p.session_id, p.item_id, 'newest_first', coalesce(first_seen, (SELECT max(first_seen) + 1 FROM seen))::DOUBLE FROM pool p LEFT JOIN seen USING (item_id)
      UNION ALL SELECT p.session_id, p.item_id, 'genre_overlap', round(coalesce(sum(c) / any_value(total), 0), 9) FROM pool p JOIN (SELECT item_id, unnest(genres) AS g FROM itm) i USING (item_id)
        LEFT JOIN (SELECT session_id, g, count(*) AS c FROM h50 JOIN (SELECT item_id AS past, unnest(genres) AS g FROM itm) USING (past) GROUP BY ALL) f ON f.session_id = p.session_id AND f.g = i.g
        LEFT JOIN (SELECT session_id, count(*) AS total FROM h50 JOIN (SELECT item_id AS past, unnest(genres) AS g FROM itm) USING (past) GROUP BY ALL) t ON t.session_id = p.session_id GROUP BY ALL
      UNION ALL SELECT p.session_id, p.item_id, 'title_overlap', round(coalesce(max(len(list_intersect(a.words, b.words)) / nullif(len(list_distinct(list_concat(a.words, b.words))), 0)), 0), 9)
        FROM pool p JOIN tok a USING (item_id) JOIN h50 h ON h.session_id = p.session_id JOIN tok b ON b.item_id = h.past GROUP BY ALL
      UNION ALL SELECT p.session_id, p.item_id, 'item_knn', round(coalesce(sum(cosine), 0), 9) FROM pool p JOIN h20 h ON h.session_id = p.session_id LEFT JOIN cosine c ON c.past = h.past AND c.item_id = p.item_id GROUP BY ALL
      UNION ALL SELECT p.session_id, p.item_id, 'sequential_transitions', round(coalesce(sum(n / (back + 1)), 0), 9) FROM pool p JOIN h5 h ON h.session_id = p.session_id LEFT JOIN trans t ON t.previous = h.past AND t.next = p.item_id GROUP BY ALL""",
    "answers": f"""SELECT *, ({u('0', 'member', 'session_id', 'item_id')} % 56 + CASE WHEN slot = 0 THEN 25 ELSE 0 END + CASE WHEN item_id = target THEN 20 ELSE 0 END)::DOUBLE AS score FROM (
      SELECT p.session_id, p.split, p.target, p.item_id, p.position, member, row_number() OVER (PARTITION BY session_id, member ORDER BY {order('0', "'present'", 'session_id', 'member', 'item_id')}, item_id) - 1 AS slot
      FROM pool p, (SELECT unnest(['direct:title', 'steps:title', 'direct:genre', 'steps:genre']) AS member))""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY session_id, member ORDER BY score DESC, position) AS rank FROM answers",
    "tau": """SELECT session_id, x.member AS a, y.member AS b, round(coalesce(sum(x.s * y.s) / nullif(sqrt(sum(abs(x.s)) * sum(abs(y.s))), 0), 0), 9) AS tau FROM sgn x JOIN sgn y USING (session_id, i, j) WHERE x.member < y.member GROUP BY ALL""",
    "sgn": "SELECT l.session_id, l.member, l.item_id AS i, r.item_id AS j, sign(l.rank - r.rank) AS s FROM ranked l JOIN ranked r ON l.session_id = r.session_id AND l.member = r.member AND l.item_id < r.item_id",
    "rel": """SELECT session_id, member, round(CASE WHEN sum(raw) OVER w > 0 THEN raw / sum(raw) OVER w ELSE 1 / count(*) OVER w END, 6) AS weight FROM (
      SELECT session_id, member, avg(tau) + 1 AS raw FROM (SELECT session_id, a AS member, tau FROM tau UNION ALL SELECT session_id, b, tau FROM tau) GROUP BY ALL) WINDOW w AS (PARTITION BY session_id)""",
    "z": """SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0 ELSE round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 9) END AS z FROM answers WINDOW w AS (PARTITION BY session_id, member)""",
    "priors": "SELECT member, slot, round(avg(z), 9) AS prior FROM z WHERE split = 'validation' GROUP BY ALL",
    "calib": "SELECT session_id, split, target, item_id, position, round(avg(z - coalesce(prior, 0)), 9) AS score FROM z LEFT JOIN priors USING (member, slot) GROUP BY ALL",
}


def metrics(scores: str, by: str = "") -> str:
    """Tie-aware metrics of rows (session_id, by, target, item_id, score)."""
    keys = f"session_id, {by}" if by else "session_id"
    sums = lambda v: f"round(list_sum([{v} FOR r IN range(g + 1, g + t + 2)]) / (t + 1), 9)"
    hr = ", ".join(f"round(greatest(least({k}, g + t + 1) - g, 0) / (t + 1), 9) AS hr{k}" for k in (1, 5, 10))
    nd = ", ".join(f"{sums(f'CASE WHEN r <= {k} THEN 1 / log2(r + 1) ELSE 0 END')} AS ndcg{k}" for k in (5, 10))
    return f"""SELECT {keys}, {sums('1 / r')} AS rr, {hr}, {nd} FROM (
      SELECT {keys}, count(*) FILTER (score > own) AS g, count(*) FILTER (score = own) - 1 AS t FROM (
        SELECT *, max(CASE WHEN item_id = target THEN score END) OVER (PARTITION BY {keys}) AS own FROM {scores}) GROUP BY ALL)"""


def means(source: str, by: str) -> str:
    cols = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("rr", "hr1", "hr5", "hr10", "ndcg5", "ndcg10"))
    return f"SELECT {by}, count(*) AS n, {cols} FROM ({source}) GROUP BY {by}"


def sql(final: str, **own: str) -> str:
    """final with the common table expressions that it needs, in order; `own` adds or replaces some (pool: which pools)."""
    parts = PARTS | own
    listed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN|,)\s+\(?\s*([a-z_0-9]+)\b", text):
            if name in parts and name not in listed:
                need(parts[name])
                if name not in listed:
                    listed.append(name)

    need(final)
    head = ",\n".join(f"{n} AS ({parts[n]})" for n in listed)
    return f"WITH {head}\n{final}" if listed else final
