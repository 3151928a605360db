"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op3_url_filter"] = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), keyed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), fits AS (
  SELECT k.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM keyed k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
  GROUP BY k.page_id
)
SELECT k.page_id, coalesce(k.host, '') AS host, coalesce(k.path, '') AS path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM keyed k LEFT JOIN fits f ON k.page_id = f.page_id
"""
ORACLE_SQL["op6_quality"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM docs WHERE len(words) >= 8
), windows AS (
  SELECT doc_id, i, words[i:i + 7] AS w FROM starts
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, len(d.words)::BIGINT AS n_words, length(array_to_string(d.words, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l.lines) - len(list_distinct(l.lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(d.text, '[^A-Za-z]', '', 'g')) AS letters,
         len(l.lines) AS n_lines
  FROM docs d JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), bits AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
    + 32 * (letters > 0 AND 100 * upper > 60 * letters)::BIGINT AS fail_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 != 0 AS base_failed,
       fail_bits & 55 = 0 AS kept, fail_bits
FROM bits
"""
ORACLE_SQL["op5_substring_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM docs WHERE len(words) >= 35
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS w FROM starts
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated
), lost AS (
  SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p
  GROUP BY e.doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(len(l.places), 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
ORACLE_SQL["op7_suffix_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents
), starts AS (
  SELECT doc_id, unnest(range(0, n_bytes - 49)) AS i, h FROM docs WHERE n_bytes >= 50
), windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS w FROM starts
), later AS (
  SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY w) < doc_id
), runs AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) > 50)::INT AS new FROM later)
), spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT d.doc_id, substr(d.h, 2 * s.before + 1, 2 * (s.s - s.before)) AS part, s.s AS place
  FROM docs d JOIN (SELECT doc_id, s, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM spans) s USING (doc_id)
  UNION ALL
  SELECT d.doc_id, substr(d.h, 2 * coalesce(s.e, 0) + 1), 1e18::BIGINT
  FROM docs d LEFT JOIN (SELECT doc_id, max(e) AS e FROM spans GROUP BY doc_id) s USING (doc_id)
), kept AS (
  SELECT doc_id, string_agg(part, '' ORDER BY place) AS h FROM gaps GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, d.n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(k.h)) AS kept_sha256
FROM docs d JOIN kept k USING (doc_id) LEFT JOIN sums s USING (doc_id)
"""
ORACLE_SQL["op8_jaccard_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM docs WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.other)::BIGINT AS component_id
FROM docs d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id
"""
ORACLE_SQL["op10_warc"] = r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html
  FROM pages
), largest AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM payloads
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept != page_id THEN kept END AS refers_to
FROM largest
"""
ORACLE_SQL["op12_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM each
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, c.last IS NOT NULL AND c.last != k.doc_id AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
ORACLE_SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE digits AS (
  SELECT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UINTEGER) AS bytes FROM documents
), crc AS (
  -- eight shifts a byte, so no table is needed
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::UINTEGER], list_transform(
    flatten(list_transform(bytes, lambda b: [b, 256::UINTEGER, 256, 256, 256, 256, 256, 256, 256])), lambda b: b::UINTEGER)),
    lambda acc, b: (CASE WHEN b < 256 THEN xor(acc, b) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384::UINTEGER) ELSE acc >> 1 END)::UINTEGER),
    4294967295::UINTEGER) AS crc
  FROM digits
), fields AS (
  SELECT doc_id, source, crc % 5 = 0 AS tampered,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS changed_body
  FROM documents JOIN crc USING (doc_id)
), leaves AS (
  SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN tampered THEN sha256(head || changed_body) ELSE sha256(head || body) END AS now,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM fields
), nodes(source, level, i, n, h) AS (
  SELECT source, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 16
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 16
), runs AS (
  SELECT false AS top, source, level, i // 16 AS run, list(h ORDER BY i) AS h FROM nodes WHERE n > 1 GROUP BY source, level, i // 16
  UNION ALL
  SELECT true, NULL, level, i // 16, list(h ORDER BY i) FROM tops WHERE n > 1 GROUP BY level, i // 16
), heights AS (
  SELECT s.source, s.i AS place, s.subroot, (SELECT max(level) FROM nodes m WHERE m.source IS NOT DISTINCT FROM s.source) AS low,
         (SELECT max(level) FROM tops) AS high
  FROM subroots s
), walk(doc_id, source, step, i, node, siblings) AS (
  SELECT doc_id, source, 0, i, now, '' FROM leaves
  UNION ALL
  SELECT w.doc_id, w.source, w.step + 1, (CASE WHEN w.step >= t.low THEN CASE WHEN w.step = t.low THEN t.place ELSE w.i END ELSE w.i END) // 16,
         sha256(array_to_string(r.h[:p.at], '') || w.node || array_to_string(r.h[p.at + 2:], '')),
         w.siblings || array_to_string(r.h[:p.at], '') || array_to_string(r.h[p.at + 2:], '')
  FROM walk w JOIN heights t ON t.source IS NOT DISTINCT FROM w.source
  JOIN LATERAL (SELECT (CASE WHEN w.step = t.low THEN t.place ELSE w.i END) AS pos) q ON true
  JOIN LATERAL (SELECT (q.pos % 16)::INT AS at) p ON true
  JOIN runs r ON r.top = (w.step >= t.low) AND (r.top OR r.source IS NOT DISTINCT FROM w.source)
   AND r.level = (CASE WHEN w.step >= t.low THEN w.step - t.low ELSE w.step END) AND r.run = q.pos // 16
  WHERE w.step < t.low + t.high
)
SELECT l.doc_id, l.leaf, t.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(w.siblings) AS proof_sha256, w.node AS folded_root,
       w.node = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN heights t ON t.source IS NOT DISTINCT FROM l.source JOIN walk w ON w.doc_id = l.doc_id AND w.step = t.low + t.high
"""
