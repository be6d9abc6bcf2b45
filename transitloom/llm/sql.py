"""DuckDB SQL for the queries that SQL can express; each states the result plainly, by all windows or pairs."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NGRAM_JACCARD_JOIN = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_SPACED}) AS w FROM documents),
  s AS (SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i)),
  n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  c AS (SELECT a.r AS u, b.r AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
  link AS (SELECT u, v FROM c JOIN n x ON u = x.r JOIN n y ON v = y.r WHERE 100 * k >= 85 * (x.n + y.n - k)),
  edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
  reach AS (SELECT r, r AS o FROM d UNION SELECT edge.v, o FROM reach JOIN edge ON edge.u = reach.r)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, x.least AS component_id FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.r, min(e.doc_id) AS least FROM reach JOIN d e ON e.r = o GROUP BY 1) x USING (r)"""

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM documents),
  item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
  known AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0),
  seen AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM known), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
  found AS (SELECT r, i, seen.n, item_id FROM seen JOIN known ON seen.g = known.g AND seen.n = known.n),
  hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
  own AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)"""

#: Windows are compared by their MD5.
SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  win AS (SELECT doc_id, p, md5(x[2 * p + 1 : 2 * p + 200]) AS g FROM d, LATERAL (SELECT unnest(range(0, CAST(len(x) / 2 AS BIGINT) - 99)) AS p)),
  gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
  edge AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS new FROM gone),
  span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge) GROUP BY doc_id, k),
  keep AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM span),
  part AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last, string_agg(x[2 * f + 1 : 2 * a], '' ORDER BY a) AS head FROM keep JOIN d USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, CAST(len(x) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || x[2 * last + 1 :], x))) AS kept_sha256 FROM d LEFT JOIN part USING (doc_id)"""

#: Pairs share one of the rarest n / 5 + 1 words of both lines, as all pairs with a similarity of 4/5 do.
LINE_DEDUP = """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
  line AS (SELECT doc_id, i, list_distinct(list_filter(string_split(ls[i], ' '), lambda w: w <> '')) AS ws FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
  w AS (SELECT doc_id, i, len(ws) AS n, unnest(ws) AS w FROM line),
  rare AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY f, w) AS k FROM (SELECT *, count(*) OVER (PARTITION BY w) AS f FROM w)),
  pre AS (SELECT doc_id, i, n, w FROM rare WHERE k <= n // 5 + 1),
  pair AS (SELECT DISTINCT y.doc_id AS yd, y.i AS yi, x.doc_id AS xd, x.i AS xi FROM pre y JOIN pre x ON x.w = y.w AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n AND (x.doc_id < y.doc_id OR x.doc_id = y.doc_id AND x.i < y.i)),
  hit AS (SELECT DISTINCT yd AS doc_id, yi AS i FROM pair JOIN line y ON y.doc_id = yd AND y.i = yi JOIN line x ON x.doc_id = xd AND x.i = xi WHERE 5 * len(list_intersect(x.ws, y.ws)) >= 4 * (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))),
  gone AS (SELECT doc_id, list(i) AS gs, count(*) AS n FROM hit GROUP BY doc_id)
  SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n, 0) AS n_removed, CASE WHEN n IS NULL THEN text ELSE coalesce((SELECT string_agg(ls[j], chr(10) ORDER BY j) FROM (SELECT unnest(range(1, len(ls) + 1)) AS j) WHERE NOT list_contains(gs, j)), '') END AS text FROM d LEFT JOIN gone USING (doc_id)"""

#: CRC-32 of the decimal conv_id, bit by bit.
_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(c AS VARCHAR), i, 1))::UBIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)::UBIGINT[]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END))"

#: Nodes are told apart by the list of all their turns; a node's ancestors are those of its smallest member.
PREFIX_TRIE = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j FROM conversations WHERE conv_id IS NOT NULL),
  h AS (SELECT c, xor({_CRC}, 4294967295::UBIGINT) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
  re AS (SELECT h.c, j, 0 AS own, role, text FROM h JOIN t ON t.c = h.c - h.c % 100 AND j <= h UNION ALL SELECT h.c, j, 1, role, text FROM h JOIN t ON t.c = h.c AND j > h),
  row AS (SELECT c, row_number() OVER w AS d, list({{'r': role, 't': text}}) OVER w AS p, length(text) AS n FROM re WINDOW w AS (PARTITION BY c ORDER BY own, j) UNION ALL SELECT c, 0, [], 0 FROM h),
  node AS (SELECT d, p, min(c) AS c, count(*) AS n_convs, any_value(n) AS n FROM row GROUP BY d, p),
  path AS (SELECT row.c AS m, row.d, node.c FROM row JOIN node ON row.d = node.d AND row.p = node.p),
  kids AS (SELECT b.d - 1 AS d, a.c, count(*) AS n_children FROM node b JOIN path a ON a.m = b.c AND a.d = b.d - 1 GROUP BY ALL),
  below AS (SELECT path.d, path.c, sum((u.n_convs - 1) * u.n) AS saved, count_if(k.c IS NULL) AS leaves FROM node u JOIN path ON path.m = u.c AND path.d <= u.d LEFT JOIN kids k ON k.c = u.c AND k.d = u.d GROUP BY ALL),
  fin AS (SELECT d, c, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS ids FROM path WHERE d = (SELECT max(d) FROM row WHERE row.c = m) GROUP BY ALL)
  SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
  FROM node JOIN below ON below.c = node.c AND below.d = node.d LEFT JOIN path up ON up.m = node.c AND up.d = node.d - 1 LEFT JOIN kids ON kids.c = node.c AND kids.d = node.d LEFT JOIN fin ON fin.c = node.c AND fin.d = node.d"""

#: Every document meets every step of every order.
FILTER_AUDIT = r"""WITH RECURSIVE o AS (SELECT '' AS p UNION ALL SELECT p || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(p, x)),
  step AS (SELECT p AS filter_order, k AS step, left(p, CAST(k - 1 AS INT)) AS seen, p[k] AS own FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE length(p) = 5),
  w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
  f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails FROM w),
  l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
  s AS (SELECT part, filter_order, step, own, contains(fails, own) AS bad, length(translate(fails, seen, '')) < length(fails) AS gone, fails = own AS sole, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id), step),
  r AS (SELECT part, filter_order, step, own, count_if(NOT bad AND NOT gone) AS kept, count_if(bad AND NOT gone) AS removed, count_if(bad AND gone) AS redundant, count_if(sole) AS unique_fails, count_if(bad AND NOT gone AND good) AS good_lost, count_if(bad AND NOT gone AND toxic) AS toxic_lost FROM s GROUP BY ALL)
  SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
