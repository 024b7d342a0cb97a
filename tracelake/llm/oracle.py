"""The queries that SQL can express on whole tables, as SQL for DuckDB."""

BYTE_REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i - 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 48)) AS i FROM h WHERE length(x) >= 100)),
least AS (SELECT w, min(doc_id) AS d FROM win GROUP BY w),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (w) WHERE d < win.doc_id),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 49 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY doc_id, run),
parts AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM runs),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (s - 1 - before)), '' ORDER BY s) || substr(min(x), 2 * max(e) + 1) AS k, sum(e - s + 1) AS r, count(*) AS c FROM parts JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
"""

WORD_REPEATS = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM t WHERE len(ws) >= 50)),
least AS (SELECT w, min(doc_id) AS d FROM win GROUP BY w),
gone AS (SELECT DISTINCT win.doc_id, i + k AS p FROM win JOIN least USING (w), (SELECT unnest(range(0, 50)) AS k) WHERE d < win.doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM t),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS k, count(*) AS n FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.p = gone.p GROUP BY u.doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

FILTER_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT x, min(doc_id) AS low FROM t GROUP BY x),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
 || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN t.doc_id > low THEN 'E' ELSE '' END AS failed FROM t JOIN firsts USING (x) LEFT JOIN marks ON t.doc_id = marks.doc_id),
cells AS (SELECT part, failed, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM f GROUP BY part, failed),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM l a, l b, l d, l e, l g
 WHERE a.c NOT IN (b.c, d.c, e.c, g.c) AND b.c NOT IN (d.c, e.c, g.c) AND d.c NOT IN (e.c, g.c) AND e.c <> g.c),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
hit AS (SELECT part, filter_order, step, own, n, g, x, contains(failed, own) AS fails, translate(failed, before, '') = failed AS came, failed = own AS alone FROM cells, steps),
sums AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (came AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (came AND fails), 0) AS removed,
 coalesce(sum(n) FILTER (fails AND NOT came), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(g) FILTER (came AND fails), 0) AS good_lost,
 coalesce(sum(x) FILTER (came AND fails), 0) AS toxic_lost FROM hit GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""

LEXICAL_SEARCH = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM t WHERE len(ws) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM t),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM u SEMI JOIN qt USING (term) GROUP BY doc_id, n, term),
d AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nn) // ll)))) AS c FROM p JOIN d USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * c) AS BIGINT) AS score FROM c JOIN qt USING (term) GROUP BY item_id, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
