"""DuckDB SQL for the queries that SQL can express; packing, forests, sampling and extraction are tested otherwise."""

from quire.llm.common import UPPER
from quire.llm.quality_rules import STOP_WORDS, THRESHOLDS

SQL: dict[str, str] = {}

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"

SQL["op1_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""

SQL["op3_warc"] = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, url, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM m"""

SQL["op4_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT sym.b, r.c FROM r JOIN sym ON sym.a = r.d)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = doc_id AS kept
  FROM (SELECT d AS doc_id, min(c) AS c FROM r GROUP BY d) m LEFT JOIN n USING (doc_id)"""

SQL["op6_repeated_substrings"] = """
WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substring(x, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, x, unnest(range(n - 199)) AS i FROM h WHERE n >= 200)),
d AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM d)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a)::BIGINT AS removed, count(*)::BIGINT AS spans FROM p JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
  FROM h LEFT JOIN k USING (doc_id)"""

SQL["op9_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, {LOWER.format(f"trim(line, {WHITE})")} AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT doc_id, line, pos, coalesce(doc_id < last, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM f GROUP BY doc_id"""

_METRICS = {
    "n_words": "n_words",
    "repeat_ratio": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
    "mean_word_chars": "word_chars::DOUBLE / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols::DOUBLE / greatest(n_words, 1)",
    "stop_ratio": "n_stop_words::DOUBLE / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
}
_BROKEN = ", ".join(f"CASE WHEN {_METRICS[m]} {op} {bound} THEN '{name}' END" for name, m, op, bound in THRESHOLDS)
_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

SQL["op10_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t))),
r AS (SELECT doc_id, sum(least(8, coalesce(next - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM x WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda y: y IN ({_STOPS})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
  FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, array_to_string(list_filter([{_BROKEN}], lambda y: y IS NOT NULL), ',') AS broken_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, n_stop_words, n_lines, broken_rules FROM b"""

#: CRC-32 of a text of ASCII: a table of 256 entries by the rule, and a fold over the bytes.
CRC = """crc_table AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""
CRC_OF = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

SQL["op11_periodic_runs"] = rf"""
WITH {CRC},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC_OF.format(key="doc_id::VARCHAR")} AS h FROM documents, crc_table),
s AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM s),
l AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE w[:a] || list_transform(range(a, n), lambda i: w[1 + a + (i - a) % p]) END AS w FROM p),
u AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM l),
e AS (SELECT u.doc_id, v.i - u.i AS q, u.i AS i FROM u JOIN u v ON u.doc_id = v.doc_id AND u.x = v.x AND u.i < v.i AND 3 * (v.i - u.i) <= u.n),
g AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g, i FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (length::DECIMAL(38, 10) / period) DESC, start, period) AS k FROM r),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM r GROUP BY doc_id),
c AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = u.doc_id AND u.i >= r.start + r.period AND u.i < r.start + r.length) GROUP BY u.doc_id)
SELECT l.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
  FROM l LEFT JOIN t ON t.doc_id = l.doc_id LEFT JOIN b ON b.doc_id = l.doc_id AND b.k = 1 LEFT JOIN c ON c.doc_id = l.doc_id"""

SQL["op13_conversation_repair"] = rf"""
WITH RECURSIVE {CRC},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_OF.format(key="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM d),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, k, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, max(k) AS n FROM f GROUP BY conv_id),
j AS (SELECT conv_id, count(*) FILTER (p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, i, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS p FROM f) WHERE p IS NOT NULL GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)) AS v(src, times, mid)),
act AS (SELECT * FROM (VALUES ('D', '', 0, 0, 2), ('D', '', 1, 1, 2), ('D', '', 2, 2, 2), ('D', '', 3, 3, 2), ('R', '', 0, 2, 1), ('R', '', 1, 2, 1), ('R', '', 2, 3, 1), ('R', '', 3, 2, 1), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0)) AS v(op, i, mid, dst, cost)),
m AS MATERIALIZED (SELECT src, dst, repeat('I', times) || op AS code, op, i, 5 * times + cost AS cost FROM ins JOIN act USING (mid)),
b AS (SELECT conv_id, 0::BIGINT AS k, 0 AS state, {{'c': 0::BIGINT, 'a': ''}} AS best FROM c
  UNION ALL SELECT b.conv_id, b.k + 1, m.dst, min({{'c': b.best.c + m.cost + CASE WHEN f.fault = 'truncated' AND op <> 'D' THEN 5 ELSE 0 END, 'a': b.best.a || m.code}})
  FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.k = b.k + 1 JOIN m ON m.src = b.state AND (op = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (op <> 'K' OR m.i = f.i) GROUP BY ALL),
e AS (SELECT c.conv_id, min({{'c': b.best.c + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'a': b.best.a || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS e FROM b JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.k = c.n GROUP BY c.conv_id),
x AS (SELECT conv_id, unnest(string_split(e.a, '')) AS op, generate_subscripts(string_split(e.a, ''), 1) AS p FROM e WHERE e.a <> ''),
y AS (SELECT *, count(*) FILTER (op <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS k FROM x),
z AS (SELECT y.conv_id, y.op, y.p, CASE WHEN y.op = 'I' THEN '' ELSE f.text END AS text, f.role, y.op = 'K' AND f.i = 's' AS sys FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.k = y.k WHERE y.op <> 'D'),
w AS (SELECT conv_id, p, text, CASE WHEN op = 'K' THEN role WHEN count(*) FILTER (NOT sys) OVER (PARTITION BY conv_id ORDER BY p) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM z),
s AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY p) AS s FROM w GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.e.c, 0) AS cost, coalesce(e.e.a, '') AS audit, sha256(coalesce(s, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN j ON j.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id"""
