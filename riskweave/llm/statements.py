"""DuckDB statements that the queries are checked against."""

from __future__ import annotations

MIX = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s GROUP BY source),
wt AS (SELECT source, source_size, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (nth % 3)::INT + 1) AS w, 3.0::DOUBLE * source_size AS most FROM per),
lv AS (SELECT *, row_number() OVER r AS place,
  (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM wt WINDOW r AS (ORDER BY most / w, source NULLS LAST)),
one AS (SELECT arg_min(level, place) AS level FROM lv WHERE level <= most / w),
goal AS (SELECT source, source_size, coalesce(least(w * (SELECT level FROM one), most), most) AS target FROM lv),
t AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS times FROM goal),
g AS (SELECT source, source_size, target, floor(times)::BIGINT AS whole, times - floor(times) AS share,
  target - floor(times)::BIGINT * source_size AS rest FROM t),
u AS (SELECT s.doc_id, s.size, g.*, (('0x' || substr(md5('mix|' || coalesce(s.doc_id::VARCHAR, '~')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
x AS (SELECT *, CASE WHEN share > 0 THEN u / (1 - u) * ((1 - share) / share) END AS v FROM u),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS middle FROM x)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((whole + CASE WHEN share > 0 AND middle <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
  (whole + CASE WHEN share > 0 AND middle <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM m
"""

DECONTAMINATE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
  row_number() OVER () AS r FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + least(10, len(w)) - 1] AS v FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
dg AS (SELECT r, s, w[s:s + k - 1] AS v, k FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, (SELECT DISTINCT len(v) AS k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dg.r, dg.s, dg.k, win.item_id FROM dg JOIN win ON dg.v = win.v),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, row_number() OVER () AS r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules (verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT r, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict
  FROM p JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, q) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (r)
"""

SEARCH = r"""
WITH dt AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM dt),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
ml AS (SELECT r, doc_id, 100 - 90 + (90 * len(t)::BIGINT * n_docs) // greatest(n_terms, 1) AS m FROM dt, total),
s AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM it JOIN tf USING (term) JOIN wt USING (term) JOIN ml USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s JOIN dt USING (r)
WHERE score > 0 QUALIFY rank <= 10
"""

CONVERSATIONS = r"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p,
  {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id AS c FROM own),
heads AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295::BIGINT) % 4 AS h FROM ids),
turns AS (SELECT c, 0 AS part, p, t FROM heads JOIN own ON own.conv_id = c - c % 20 AND p <= h
  UNION ALL SELECT c, 1, p, t FROM heads JOIN own ON own.conv_id = c AND p > h),
seq AS (SELECT c, coalesce(list(t ORDER BY part, p) FILTER (t IS NOT NULL), []) AS q FROM ids LEFT JOIN turns USING (c) GROUP BY c),
pre AS (SELECT c, unnest(range(len(q) + 1)) AS d, q FROM seq),
node AS (SELECT q[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(q[1:d - 1]) AS up,
  CASE WHEN d > 0 THEN len(regexp_extract_all(any_value(q[d].text), '[^\x20\x09-\x0D]+')) ELSE 0 END AS words,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(q) = d), '')) AS ends_sha256 FROM pre GROUP BY q[1:d], d),
kid AS (SELECT k, d, sum(n) AS n FROM (SELECT up AS k, d - 1 AS d, 1 AS n FROM node WHERE d > 0) GROUP BY k, d),
one AS (SELECT node.*, coalesce(kid.n, 0)::BIGINT AS n_children FROM node LEFT JOIN kid USING (k, d)),
sub AS (SELECT k[1:a] AS k, a AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM one) GROUP BY ALL)
SELECT one.conv_id, one.d::BIGINT AS depth, up.conv_id AS parent_conv_id, one.n_convs::BIGINT AS n_convs, one.n_children, n_leaves, saved_tokens, one.ends_sha256
FROM one JOIN sub USING (k, d) LEFT JOIN node up ON up.k = one.up AND up.d = one.d - 1
"""
