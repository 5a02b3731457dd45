"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

import string

_LOW = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"coalesce(regexp_extract_all({x}, '[^\x20\x09-\x0D]+'), [])"
_ALNUM = r"coalesce(regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = f"""WITH b AS (SELECT item_id, {_ALNUM.format(x=_LOW)} AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win FROM bi),
d AS (SELECT doc_id, {_ALNUM.format(x=_LOW)} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT di.doc_id, di.i, di.n, bw.item_id FROM di JOIN bw ON bw.n = di.n AND bw.win = array_to_string(di.w[di.i : di.i + di.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(x=_LOW)} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS sh FROM i), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_WORDS.format(x="text")} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13), x AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS win FROM i),
f AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT x.doc_id, unnest(range(k, k + 13)) AS p FROM x JOIN f ON f.win = x.win WHERE f.first < x.doc_id)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u ANTI JOIN c ON c.doc_id = u.doc_id AND c.p = u.p GROUP BY u.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT *, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: right(format('{:04b}', strpos('0123456789abcdef', c) - 1), 4)), '') AS bits FROM s),
q AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(list_sum(list_transform(range(0, 5), lambda t: CAST(substr(bits, j * 5 + t + 1, 1) AS INTEGER) * CAST(power(2, 4 - t) AS INTEGER))) AS INTEGER) + 1, 1)), '') AS digest FROM b)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> last THEN last END AS refers_to, true AS valid FROM q"""

EMBEDDING = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9::DOUBLE),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id JOIN c ON c.vec_id = v.vec_id"""

PRICE_BAND = """WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
i AS (SELECT row_number() OVER () AS k, item_id, CAST(floor(100 * price + 0.5::DOUBLE) AS BIGINT) AS p FROM items),
s AS (SELECT sale_id, CAST(line_no AS BIGINT) AS line_no, item_id AS line_item_id, CAST(floor(100 * amount + 0.5::DOUBLE) AS BIGINT) AS a, CAST(quantity AS BIGINT) AS q FROM sale_lines
  WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL),
l AS (SELECT sale_id, line_no, line_item_id, (2 * a + q) // (2 * q) AS u, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id || ',' || line_no || ',' || line_item_id, ''), lambda h: ascii(h)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM s, tab),
m AS (SELECT i.k, i.item_id, abs(l.u - i.p) AS gap, l.* FROM i JOIN l ON l.line_item_id <> i.item_id AND (abs(l.u - i.p) <= 50 OR 1000 * abs(l.u - i.p) <= 5 * least(l.u, i.p))),
z AS (SELECT k, count(*) AS n_pairs, CAST(sum(gap) AS BIGINT) AS gap_sum, CAST(sum(crc) AS BIGINT) AS lines_crc FROM m GROUP BY k),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gap, u, sale_id, line_no, line_item_id) AS rank FROM m) WHERE rank <= 10)
SELECT i.item_id, CAST(coalesce(f.rank, 0) AS INTEGER) AS rank, f.gap, f.u, f.sale_id, f.line_no, f.line_item_id, coalesce(z.n_pairs, 0) AS n_pairs, coalesce(z.gap_sum, 0) AS gap_sum, coalesce(z.lines_crc, 0) AS lines_crc
FROM i LEFT JOIN z ON z.k = i.k LEFT JOIN f ON f.k = i.k"""

FILTER_AUDIT = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, {_WORDS.format(x="t")} AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN q ON q.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
o AS (SELECT '' AS p UNION ALL SELECT p || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE strpos(p, c) = 0),
k AS (SELECT p AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(p) = 5),
s AS (SELECT g.*, filter_order, step, substr(filter_order, step, 1) AS f, length(translate(left(filter_order, step - 1), fails, '')) < step - 1 AS gone FROM g, k),
v AS (SELECT part, filter_order, step, f, sum(n) FILTER (WHERE NOT gone AND strpos(fails, f) = 0) AS kept, sum(n) FILTER (WHERE NOT gone AND strpos(fails, f) > 0) AS removed, sum(n) FILTER (WHERE gone AND strpos(fails, f) > 0) AS redundant,
  sum(n) FILTER (WHERE fails = f) AS unique_fails, sum(good) FILTER (WHERE NOT gone AND strpos(fails, f) > 0) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND strpos(fails, f) > 0) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM v"""
