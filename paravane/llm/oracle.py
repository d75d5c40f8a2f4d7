"""DuckDB SQL for the operators that SQL can express, written without their methods.

op6: all pairs that share a shingle, the exact similarity, and a recursive reach.
op10: all windows of the documents that share a shingle with an item, wherever
they start, and their exact similarity, with no fingerprints.
"""

from __future__ import annotations

OP6 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
e AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT ends.b, r.root FROM r JOIN ends ON ends.a = r.id AND r.root < ends.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY ALL"""

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len({0}) >= 5 THEN list_transform(range(1, len({0}) - 3), lambda j: array_to_string({0}[j:j + 4], ' ')) ELSE [array_to_string({0}, ' ')] END"

OP10 = rf"""WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, w, len(w) AS m, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
ir AS (SELECT item_id, m, k, j AS item_at, array_to_string(w[j + 1:j + k], ' ') AS s FROM (SELECT *, unnest(range(0, m - k + 1)) AS j FROM i)),
dr AS (SELECT doc_id, k, j AS pos, array_to_string(w[j + 1:j + k], ' ') AS s FROM (SELECT d.doc_id, kk.k, d.w, unnest(range(0, greatest(len(d.w) - kk.k + 1, 0))) AS j FROM d CROSS JOIN (SELECT DISTINCT k FROM i) kk)),
q AS (SELECT DISTINCT doc_id, item_id, m FROM dr JOIN ir ON dr.s = ir.s AND dr.k = ir.k),
p AS (SELECT q.doc_id, q.item_id, q.m, d.w, unnest(range(0, len(d.w))) AS st FROM q JOIN d ON d.doc_id = q.doc_id),
x AS (SELECT doc_id, item_id, st, w[st + 1:st + m] AS a FROM p),
ax AS (SELECT doc_id, item_id, st, m, s, count(*) AS c FROM (SELECT doc_id, item_id, st, len(a) AS m, unnest({_SHINGLES.format('a')}) AS s FROM x) GROUP BY ALL),
bx AS (SELECT item_id, s, count(*) AS c FROM (SELECT item_id, unnest({_SHINGLES.format('w')}) AS s FROM i) GROUP BY ALL),
ta AS (SELECT doc_id, item_id, st, m, sum(c * length(replace(s, ' ', ''))) AS t FROM ax GROUP BY ALL),
tb AS (SELECT item_id, sum(c * length(replace(s, ' ', ''))) AS t FROM bx GROUP BY ALL),
low AS (SELECT doc_id, ax.item_id, st, sum(least(ax.c, bx.c) * length(replace(ax.s, ' ', ''))) AS l FROM ax JOIN bx ON ax.item_id = bx.item_id AND ax.s = bx.s GROUP BY ALL),
f AS (SELECT ta.doc_id, ta.item_id, ta.st, ta.m, CAST(low.l AS DOUBLE) / CAST(ta.t + tb.t - low.l AS DOUBLE) AS v FROM ta JOIN tb ON ta.item_id = tb.item_id JOIN low ON low.doc_id = ta.doc_id AND low.item_id = ta.item_id AND low.st = ta.st)
SELECT doc_id, item_id, CAST(st AS INTEGER) AS start_word, CAST(m AS INTEGER) AS n_words, v AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY v DESC, st) AS rn FROM f WHERE v >= 0.8) WHERE rn = 1"""

SQL = {"op6_jaccard_join": OP6, "op10_decontaminate": OP10}
