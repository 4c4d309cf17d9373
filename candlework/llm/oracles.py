"""DuckDB SQL for the queries of this subpackage that SQL can express: plain comparisons of all with all.

No SQL is given where a tokenizer (op2, op6), floating-point sums in a stated order (op5), minimum cuts (op7), rank lists
in code point tables (op10) or lists of canonical texts (op3) would be needed; tests hold these against brute force.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[^\x20\x09-\x0D]+"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


#: Components of a relation link(a, b) over vertices vertex(v), by the smallest id that links lead to.
_REACH = """both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(v, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.seen = e.a),
least AS (SELECT v, min(seen) AS component_id FROM reach GROUP BY v)"""

ORACLES: dict[str, str] = {
    "op1_winnowing": rf"""
WITH d AS (SELECT doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
at_item AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0),
item_window AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM at_item),
kinds AS (SELECT DISTINCT k FROM item_window),
at_doc AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, kinds WHERE len(w) >= k),
doc_window AS (SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM at_doc),
hit AS (SELECT doc_id, p, k, item FROM doc_window JOIN item_window USING (k, g)),
place AS (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hit)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM place GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN listed l ON d.doc_id = l.doc_id""",
    "op4_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_BLANK)} AS w FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS p FROM d WHERE len(w) > 0),
shingle AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS s FROM place),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared s JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
{_REACH}
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least ON least.v = d.doc_id""",
    "op8_near_vectors": f"""
WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM x
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(e, e) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) WHERE list_dot_product(p.e, q.e) >= 0.9 * p.norm * q.norm),
{_REACH},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT x.vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, coalesce(component_id, x.vec_id) AS component_id, coalesce(component_id, x.vec_id) = x.vec_id AS kept
FROM x LEFT JOIN least ON least.v = x.vec_id LEFT JOIN degree ON degree.a = x.vec_id""",
    "op9_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_BLANK}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
weighed AS (SELECT source, n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
below AS (SELECT *, CAST(sum(n) OVER () - coalesce(3 * sum(n) OVER before, 0) AS BIGINT) AS rest, CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS open
  FROM weighed WINDOW before AS (ORDER BY CAST(n AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, open FROM below WHERE 3 * n * open >= w * rest ORDER BY CAST(n AS DOUBLE) / w, source NULLS LAST LIMIT 1),
goal AS (SELECT source, n, CASE WHEN 3 * n * open <= w * rest THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / open END AS target FROM weighed, level),
drawn AS (SELECT doc_id, size, n AS source_size, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn""",
}
