"""SQL equivalents of the registered queries, where SQL can state them over whole tables."""

_SPANS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300),
w AS (SELECT doc_id, p, md5(substr(text, CAST(p AS INT) + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 299)) AS p FROM d)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM r)),
n AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 300 THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS stretch FROM n),
spans AS (SELECT doc_id, CAST(min(p) AS INT) AS start_pos, CAST(max(p) + 300 AS INT) AS end_pos FROM g GROUP BY doc_id, stretch)
"""

#: Python's letters and digits, as RE2 classes.
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"

#: One row per memory with 64 finite numbers, not all zero, scaled to unit length.
_UNIT = """
WITH raw AS (SELECT mem_id, any_value(tenant) AS tenant, any_value(CAST(vec AS DOUBLE[])) AS v FROM memories WHERE mem_id IS NOT NULL AND len(vec) = 64 GROUP BY mem_id),
good AS (SELECT mem_id, tenant, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raw
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
unit AS (SELECT mem_id, tenant, CAST(list_transform(v, lambda x: x / n) AS DOUBLE[64]) AS u FROM good)
"""

_NEAREST = _UNIT + """,
pairs AS (SELECT a.mem_id AS id, b.mem_id AS neighbour, array_inner_product(a.u, b.u) AS cosine FROM unit a JOIN unit b ON a.tenant = b.tenant AND a.mem_id <> b.mem_id),
best AS (SELECT id, neighbour, cosine FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, neighbour) <= 5)
"""

_SHINGLES = """
WITH m AS (SELECT mem_id, any_value(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM memories WHERE mem_id IS NOT NULL AND text IS NOT NULL GROUP BY mem_id),
s AS (SELECT DISTINCT mem_id, array_to_string(w[k + 1:k + 3], ' ') AS g FROM (SELECT mem_id, w, unnest(range(greatest(len(w) - 2, 0))) AS k FROM m)),
n AS (SELECT mem_id, count(*) AS n FROM s GROUP BY mem_id),
c AS (SELECT a.mem_id AS a, b.mem_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.mem_id < b.mem_id GROUP BY ALL)
SELECT a AS mem_id_a, b AS mem_id_b FROM c JOIN n x ON x.mem_id = a JOIN n y ON y.mem_id = b WHERE common >= 0.6 * (x.n + y.n - common) - 1e-9
"""

_CHAINS = """
WITH r AS (SELECT DISTINCT tenant, item_id AS item, ts_ns AS t, seq AS s FROM access_log WHERE item_id IS NOT NULL),
least_n AS (SELECT 0.1 * count(DISTINCT tenant) - 1e-9 AS n FROM r),
c1 AS (SELECT item, count(DISTINCT tenant) AS support FROM r GROUP BY item HAVING support >= (SELECT n FROM least_n)),
f AS (SELECT r.* FROM r JOIN c1 USING (item)),
st AS (SELECT x.tenant, x.item AS a, x.t AS ta, x.s AS sa, y.item AS b, y.t AS tb, y.s AS sb
  FROM f x JOIN f y ON x.tenant = y.tenant AND y.t >= x.t AND y.t <= x.t + 60000000000 AND (y.t > x.t OR y.s > x.s) AND x.item <> y.item),
c2 AS (SELECT a, b, count(DISTINCT tenant) AS support FROM st GROUP BY a, b HAVING support >= (SELECT n FROM least_n)),
st2 AS (SELECT st.* FROM st JOIN c2 USING (a, b)),
l2 AS (SELECT [a, b] AS p, tenant, b AS item, tb AS t, sb AS s FROM st2)"""
for _n in range(3, 9):
    _CHAINS += f""",
l{_n} AS (SELECT DISTINCT list_append(l.p, st2.b) AS p, l.tenant, st2.b AS item, tb AS t, sb AS s FROM l{_n - 1} l {"JOIN c" + str(_n - 1) + " c ON c.p = l.p" if _n > 3 else ""}
  JOIN st2 ON st2.tenant = l.tenant AND st2.a = l.item AND st2.ta = l.t AND st2.sa = l.s WHERE NOT list_contains(l.p, st2.b)),
c{_n} AS (SELECT p, count(DISTINCT tenant) AS support FROM l{_n} GROUP BY p HAVING support >= (SELECT n FROM least_n))"""
_CHAINS += """,
chains AS (SELECT p, support FROM c3 UNION ALL SELECT p, support FROM c4 UNION ALL SELECT p, support FROM c5 UNION ALL SELECT p, support FROM c6 UNION ALL SELECT p, support FROM c7 UNION ALL SELECT p, support FROM c8)
"""

ORACLES = {
    "p1_found": _CHAINS + "SELECT array_to_string(p, '>') AS pattern FROM chains",
    "p1_support": _CHAINS
    + """SELECT array_to_string(p, '>') AS pattern, CAST(len(p) AS INTEGER) AS n_items, support FROM
(SELECT [item] AS p, support FROM c1 UNION ALL SELECT [a, b], support FROM c2 UNION ALL SELECT p, support FROM chains)""",
    "p5_found": "\nWITH RECURSIVE" + _UNIT.strip()[4:] + """,
links AS MATERIALIZED (SELECT a.mem_id AS a, b.mem_id AS b FROM unit a JOIN unit b ON a.mem_id <> b.mem_id AND array_inner_product(a.u, b.u) >= 0.70),
reach AS (SELECT mem_id AS m, mem_id AS r FROM unit WHERE mem_id NOT IN (SELECT a FROM links WHERE b < a) UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.m),
r4 AS (SELECT m AS mem_id, min(r) AS c FROM reach GROUP BY m),
big AS (SELECT mem_id, c FROM r4 QUALIFY count(*) OVER (PARTITION BY c) >= 8),
tags AS (SELECT DISTINCT mem_id, lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS tag FROM (SELECT mem_id, unnest(tags) AS t FROM memories) WHERE trim(t) <> ''),
top AS (SELECT c, tag FROM (SELECT c, tag, count(*) AS n FROM tags JOIN big USING (mem_id) GROUP BY c, tag) QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, tag) = 1)
SELECT coalesce(tag, '') AS cluster_label, mem_id FROM big LEFT JOIN top USING (c)""",
    "p6_found": _SHINGLES,
    "p6_groups": """
WITH RECURSIVE m AS (SELECT mem_id, any_value(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM memories WHERE mem_id IS NOT NULL AND text IS NOT NULL GROUP BY mem_id),
s AS (SELECT DISTINCT mem_id, array_to_string(w[k + 1:k + 5], ' ') AS g FROM (SELECT mem_id, w, unnest(range(greatest(len(w) - 4, 0))) AS k FROM m)),
t AS (SELECT mem_id, string_agg(g, '|' ORDER BY g) AS key, count(*) AS n FROM s GROUP BY mem_id),
cl AS (SELECT mem_id, n, min(mem_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS n_copies FROM t),
rs AS (SELECT s.mem_id, g FROM s JOIN cl ON cl.mem_id = s.mem_id AND cl.class_id = cl.mem_id),
cm AS (SELECT a.mem_id AS a, b.mem_id AS b, count(*) AS common FROM rs a JOIN rs b ON a.g = b.g AND a.mem_id < b.mem_id GROUP BY ALL),
ln AS (SELECT a, b FROM cm JOIN t x ON x.mem_id = a JOIN t y ON y.mem_id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
bo AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln), dg AS (SELECT a, count(*) AS n_links FROM bo GROUP BY a),
reach AS (SELECT DISTINCT a AS m, a AS r FROM bo UNION SELECT bo.b, reach.r FROM reach JOIN bo ON bo.a = reach.m), gr AS (SELECT m, min(r) AS group_id FROM reach GROUP BY m)
SELECT mem_id, class_id, n_copies, coalesce(n_links, 0) AS n_links, coalesce(group_id, class_id) AS group_id FROM cl LEFT JOIN dg ON dg.a = class_id LEFT JOIN gr ON gr.m = class_id""",
    "p7_found": _NEAREST + "SELECT DISTINCT least(id, neighbour) AS mem_id_a, greatest(id, neighbour) AS mem_id_b FROM best",
    "p7_neighbours": _NEAREST + "SELECT id AS mem_id, neighbour, round(cosine, 6) AS cosine FROM best",
    "p9_found": f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k + 1:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 11, 0))) AS k FROM i)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k + 1:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 11, 0))) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p10_found": _SPANS + "SELECT doc_id, start_pos, end_pos FROM spans",
    "p10_shared_share": _SPANS
    + """SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, count(*) AS n_spans, CAST(sum(end_pos - start_pos) AS BIGINT) AS shared_chars,
CAST(sum(end_pos - start_pos) AS DOUBLE) / length(text) AS share FROM spans JOIN documents USING (doc_id) GROUP BY doc_id, text""",
}
