"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

WORDS9 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS9} AS w FROM documents),
b AS (SELECT item_id, {WORDS9} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN g USING (k, gram)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


TERMS11 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest({TERMS11}) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(lc) AS nl FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1)) // CAST(n + v AS HUGEINT) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (lc + 1)) // CAST(nl + v AS HUGEINT) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
          (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP12 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS before, sum(source_size) OVER () AS words, sum(w) OVER () AS ws
      FROM w WINDOW o AS (ORDER BY cap * 10 // w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, (words - caps) * w > cap * (ws - before) AS is_full FROM f),
r AS (SELECT max(CAST(words - caps AS DOUBLE) / CAST(ws - before AS DOUBLE)) AS rate FROM u WHERE NOT is_full),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE coalesce(rate, 0.0::DOUBLE) * CAST(w AS DOUBLE) END AS target,
             CAST(('0x' || substr(md5('mix|' || coalesce(source, chr(0))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS o FROM u, r),
x AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS i FROM d),
y AS (SELECT x.doc_id, x.source, x.size, t.source_size, t.target, i, o, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0.0::DOUBLE END AS rate
      FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source),
z AS (SELECT *, CAST(least(floor(CAST(i + 1 AS DOUBLE) * rate + o) - floor(CAST(i AS DOUBLE) * rate + o), 3) AS BIGINT) AS copies FROM y)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM z
"""


def sqls() -> dict[str, str]:
    return {"op9_benchmark_decontamination": OP9, "op11_source_divergence": OP11, "op12_source_mixing": OP12}
