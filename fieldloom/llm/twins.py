"""SQL twins of queries over words and windows, for DuckDB."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LETTERS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""

REPEATED_WORDS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h),
k AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) t ANTI JOIN c ON c.doc_id = t.doc_id AND c.i = t.i
  GROUP BY t.doc_id
),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
"""

CONTAMINATED = f"""
WITH d AS (SELECT doc_id, {_LETTERS.format(_LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_LETTERS.format(_LOWER)} AS w, least(len(w), 10) AS n FROM benchmark WHERE len(w) > 0),
v AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
),
g AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM v) ON len(w) >= n)
),
h AS (SELECT doc_id, i, g.n, item FROM g JOIN v ON g.n = v.n AND g.s = v.s),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

BEST_VECTORS = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_P = "1 + (CAST(1000000000 AS HUGEINT) * ({} + 1)) // ({} + v)"

SOURCE_DIVERGENCE = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, {_TERMS.format(_LOWER)} AS w FROM documents
),
t AS (SELECT lang, source, doc, unnest(w) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format("coalesce(c.n, 0)", "g.total")} AS p, {_P.format("k.n", "l.total")} AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""


def _round(entries: str) -> str:
    """(r, p, c, d, k): each part with its nearest of the ``entries`` (p, k, c)."""
    square = "list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - e.c[i]) * (x.c[i] - e.c[i])))"
    return f"""
  SELECT r, p, c, m // 64 AS d, m % 64 AS k
  FROM (SELECT x.r, x.p, any_value(x.c) AS c, CAST(min({square} * 64 + e.k) AS BIGINT) AS m FROM x JOIN {entries} e ON e.p = x.p GROUP BY x.r, x.p)"""


def _means(entries: str, assigned: str) -> str:
    """The entries after a round: floors of means, unused ones as they were."""
    return f"""
  SELECT e.p, e.k, coalesce(n.c, e.c) AS c FROM {entries} e LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT p, k, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT p, k, unnest(c) AS y, unnest(range(1, len(c) + 1)) AS i FROM {assigned}) GROUP BY p, k, i
    ) GROUP BY p, k
  ) n ON n.p = e.p AND n.k = e.k"""


VECTOR_CODES = f"""
WITH f AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS r FROM f),
x AS MATERIALIZED (SELECT r, p, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] AS c FROM v, range(16) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS k, c FROM x WHERE r <= 64),
a0 AS MATERIALIZED ({_round("c0")}),
c1 AS MATERIALIZED ({_means("c0", "a0")}),
a1 AS MATERIALIZED ({_round("c1")}),
c2 AS MATERIALIZED ({_means("c1", "a1")}),
a2 AS MATERIALIZED ({_round("c2")}),
o AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
b AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, i)) AS s FROM (SELECT p, k, unnest(c) AS y, unnest(range(1, len(c) + 1)) AS i FROM c2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, b.s AS codebooks_sha256
FROM v JOIN o ON o.r = v.r, b
"""
