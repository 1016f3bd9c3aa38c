"""DuckDB SQL of those training-data queries that SQL can express, written from their definitions."""

from __future__ import annotations

from . import decontaminate, licenses as lic, mixing as mix


def _case(column: str, weights: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v!r}::DOUBLE" for k, v in weights.items()) + f" ELSE {mix.DEFAULT_WEIGHT!r}::DOUBLE END"


def _shares(source: str, parent: str) -> str:
    """CTE body: source (parent columns, name, weight, capacity, budget) with share."""
    order = f"PARTITION BY {parent} ORDER BY capacity / weight, name"
    return f"""SELECT *, CASE WHEN filled THEN capacity ELSE greatest(0.0, least(capacity, common * weight)) END AS share FROM (
      SELECT *, first_value(CASE WHEN NOT filled THEN rate END IGNORE NULLS) OVER (PARTITION BY {parent} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM (
        SELECT *, capacity <= rate * weight AS filled FROM (
          SELECT *, (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
            row_number() OVER ({order}) AS n FROM {source})))"""


def mixing() -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CASE WHEN source IS NULL THEN '(none)' WHEN coalesce(try_cast(nullif(regexp_extract(source, '(\d{{1,9}})$', 1), '') AS BIGINT), 999999999) < 7 THEN 'web'
      WHEN coalesce(try_cast(nullif(regexp_extract(source, '(\d{{1,9}})$', 1), '') AS BIGINT), 999999999) < 14 THEN 'books' ELSE 'code' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, coalesce(doc_id::VARCHAR, md5(text)) AS named FROM documents),
t AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
dom0 AS (SELECT 0 AS root, domain AS name, {_case('domain', mix.DOMAIN_WEIGHTS)} AS weight, (sum(tokens) * {mix.EPOCHS})::DOUBLE AS capacity,
    floor(sum(sum(tokens)) OVER () * {mix.FRACTION!r}::DOUBLE)::DOUBLE AS budget FROM leaves GROUP BY domain),
dom AS ({_shares('dom0', 'root')}),
lang0 AS (SELECT l.domain, l.lang AS name, {_case('l.lang', mix.LANG_WEIGHTS)} AS weight, l.capacity, dom.share AS budget
    FROM (SELECT domain, lang, (sum(tokens) * {mix.EPOCHS})::DOUBLE AS capacity FROM leaves GROUP BY ALL) l JOIN dom ON dom.name = l.domain),
lng AS ({_shares('lang0', 'domain')}),
src0 AS (SELECT l.domain, l.lang, l.source AS name, 1.0::DOUBLE AS weight, (l.tokens * {mix.EPOCHS})::DOUBLE AS capacity, l.tokens, lng.share AS budget
    FROM leaves l JOIN lng ON lng.domain = l.domain AND lng.name = l.lang),
src AS ({_shares('src0', 'domain, lang')}),
q AS (SELECT domain, lang, name AS source, tokens, least(floor(share + 1e-6)::BIGINT, tokens * {mix.EPOCHS}) AS quota FROM src),
o AS (SELECT t.*, q.quota // q.tokens AS whole, q.quota % q.tokens AS rest, md5('{mix.SEED}:' || (q.quota // q.tokens) || ':' || named) AS o
    FROM t JOIN q USING (domain, lang, source)),
r AS (SELECT *,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
p AS (SELECT *, greatest(0, least(n_tokens, rest - before))::BIGINT AS prefix FROM r)
SELECT doc_id, domain, lang, source, n_tokens, whole::BIGINT AS whole_epochs, prefix AS prefix_tokens, (whole * n_tokens + prefix)::BIGINT AS taken_tokens
FROM p WHERE whole * n_tokens + prefix > 0"""


def ngram_join() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[i : i + 2] ELSE w END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS to_id FROM g UNION SELECT r.doc_id, g.b FROM reach r JOIN g ON g.a = r.to_id),
m AS (SELECT doc_id, min(to_id) AS component FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.component, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def licenses() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(lic.TEMPLATES.items()))
    k = lic.SHINGLE
    cut = f"CASE WHEN len(w) >= {k} THEN w[i : i + {k - 1}] ELSE w END"
    places = f"unnest(range(1, greatest(len(w) - {k - 2}, 2)))"
    return rf"""
WITH t AS (SELECT license, regexp_extract_all(lower(text), '{lic.WORD}') AS w FROM (VALUES {values}) v(license, text)),
ts AS (SELECT DISTINCT license, {cut} AS s FROM (SELECT *, {places} AS i FROM t)),
tn AS (SELECT license, count(*) AS n, pow(2, ceil(log2(count(*))))::INT AS u FROM ts GROUP BY license),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{lic.WORD}') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS i, {cut} AS s FROM (SELECT *, {places} AS i FROM d WHERE len(w) > 0)),
h AS (SELECT p.doc_id, p.i, p.s, ts.license, tn.n, tn.u FROM p JOIN ts USING (s) JOIN tn USING (license)),
x AS (SELECT doc_id, license, n, i // u AS b, u, s FROM h UNION ALL SELECT doc_id, license, n, i // u - 1, u, s FROM h WHERE i // u > 0),
c AS (SELECT doc_id, license, b * u AS first, count(DISTINCT s) / any_value(n) AS c FROM x GROUP BY ALL)
SELECT doc_id, license, max(c) AS containment, count(*)::BIGINT AS n_windows, min(first)::INT AS first_word FROM c WHERE c >= {lic.THRESHOLD} GROUP BY ALL"""


def decontamination() -> str:
    k = decontaminate.WORDS
    word = r"[a-z0-9\x{80}-\x{10FFFF}]+"
    cut = f"CASE WHEN len(w) >= {k} THEN w[i : i + {k - 1}] ELSE w END"
    places = f"unnest(range(1, greatest(len(w) - {k - 2}, 2)))"
    return rf"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, {cut} AS s FROM (SELECT *, {places} AS i FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM documents),
p AS (SELECT DISTINCT doc_id, {cut} AS s FROM (SELECT *, {places} AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, item_id, count(*) AS c FROM p JOIN s USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n::INT AS n_item_shingles, c::INT AS n_shared, c / n AS containment FROM c JOIN n USING (item_id) WHERE c >= {decontaminate.THRESHOLD} * n"""
