"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION_CTES = rf"""
item_words AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_WORDS} AS w FROM {{documents}}),
doc_windows AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM item_windows))),
occurrences AS (SELECT rid, item_id, i, size FROM doc_windows JOIN item_windows USING (size, gram)),
hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM occurrences)) GROUP BY rid),
hit_items AS (
  SELECT rid, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items,
         array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)), ',') AS names
  FROM occurrences GROUP BY rid)"""

OP2 = f"""
WITH {CONTAMINATION_CTES.format(documents='documents')}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"""

SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = f"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, {SPACE_WORDS} AS w FROM documents),
grams AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE doc_id IS NOT NULL)),
least_ids AS (SELECT gram, min(doc_id) AS first_id FROM grams GROUP BY gram),
gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p
  FROM grams JOIN least_ids USING (gram) WHERE first_id < doc_id),
lost AS (SELECT rid, list(p) AS places FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE
         list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (rid)"""

OP8 = f"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {SPACE_WORDS} AS w FROM documents),
windows AS (
  SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
repeats AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS times FROM windows) WHERE times > 1),
repeat_words AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeats) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
measured AS (
  SELECT rid, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN repeat_words USING (rid) LEFT JOIN lines USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > word_chars AS symbols_failed,
         2 * n_dup_lines > n_lines AS lines_failed FROM measured),
rule_rows AS (
  SELECT source, 'base' AS rule, base_failed AS failed FROM judged UNION ALL SELECT source, 'symbols', symbols_failed FROM judged
  UNION ALL SELECT source, 'lines', lines_failed FROM judged),
host_counts AS (SELECT source, rule, count(*) AS n, sum(CAST(failed AS INT)) AS f FROM rule_rows GROUP BY source, rule),
priors AS (SELECT rule, sum(f) / sum(n) AS m, var_pop(f / n) AS v FROM host_counts GROUP BY rule),
weights AS (SELECT rule, m, greatest(1.0, least(1e6, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END)) AS weight FROM priors),
hosts AS (
  SELECT source, bool_or((f + m * weight) / (n + weight) > 0.5) AS rejected FROM host_counts JOIN weights USING (rule) GROUP BY source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN hosts ON judged.source IS NOT DISTINCT FROM hosts.source"""


OP13 = rf"""
WITH RECURSIVE
steps AS (
  SELECT 0 AS k, b, b AS v FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
bytes AS MATERIALIZED (SELECT b, v FROM steps WHERE k = 8),
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_WORDS} AS w, true AS raw FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, {_ALNUM_WORDS}, false FROM benchmark),
places AS (SELECT rid, raw, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, (SELECT unnest([1, 2, 3]) AS k)),
grams AS MATERIALIZED (SELECT rid, raw, array_to_string(w[i:i + k - 1], ' ') AS gram, count(*) AS times FROM places GROUP BY ALL),
different AS MATERIALIZED (SELECT row_number() OVER () AS gid, gram, strlen(gram) AS n, hex(gram) AS digits FROM (SELECT DISTINCT gram FROM grams)),
contributions AS MATERIALIZED (
  SELECT 0 AS d, b, v FROM bytes
  UNION ALL SELECT d + 1, c.b, xor(c.v >> 8, bytes.v) FROM contributions c JOIN bytes ON bytes.b = c.v & 255
  WHERE d + 1 < (SELECT max(n) FROM different)),
zeros AS MATERIALIZED (
  SELECT 0 AS n, 4294967295 AS v
  UNION ALL SELECT n + 1, xor(z.v >> 8, bytes.v) FROM zeros z JOIN bytes ON bytes.b = z.v & 255
  WHERE n < (SELECT max(n) FROM different)),
gram_bytes AS (
  SELECT gid, n - 1 - i AS d, CAST('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT) AS b
  FROM (SELECT *, unnest(range(n)) AS i FROM different)),
sums AS (SELECT gid, bit_xor(v) AS v FROM gram_bytes JOIN contributions USING (d, b) GROUP BY gid),
buckets AS MATERIALIZED (
  SELECT gram, xor(sums.v, xor(zeros.v, 4294967295)) % 10000 AS bucket
  FROM sums JOIN different USING (gid) JOIN zeros USING (n)),
placed AS MATERIALIZED (SELECT rid, raw, bucket, sum(times) AS n FROM grams JOIN buckets USING (gram) GROUP BY rid, raw, bucket),
counts AS (
  SELECT bucket, CAST(sum(n) FILTER (raw) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT raw), 0) AS DOUBLE) AS t
  FROM placed GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM counts, totals WHERE s IS NOT NULL),
weights AS (
  SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE raw GROUP BY rid),
scored AS (
  SELECT doc_id, len(w) >= 20 AS long_enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
           AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (rid) WHERE texts.raw),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN long_enough AND place <= (SELECT count(*) * 5 // 100 FROM scored WHERE long_enough) THEN place END AS rank
FROM ranked"""


OP11 = r"""
WITH RECURSIVE
ids AS MATERIALIZED (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS name, hex(CAST(conv_id AS VARCHAR)) AS digits
  FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id FROM conversations WHERE conv_id IS NOT NULL)),
registers AS (
  SELECT conv_id, digits, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM ids
  UNION ALL
  SELECT conv_id, digits, i + 1, xor(CASE WHEN i % 9 = 0 THEN xor(v, CAST('0x' || substr(digits, 2 * (i // 9) + 1, 2) AS BIGINT))
                                     WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, 0)
  FROM registers WHERE i < 9 * (length(digits) // 2)),
heads AS (SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM registers WHERE i = 9 * (length(digits) // 2)),
turns AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
  FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn,
               substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL)),
rebuilt AS (
  SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM (SELECT heads.conv_id, digest, words, pos, 0 AS own FROM heads JOIN turns ON turns.conv_id = heads.conv_id - heads.conv_id % 20 AND pos <= h
        UNION ALL SELECT conv_id, digest, words, pos, 1 FROM heads JOIN turns USING (conv_id) WHERE pos > h)),
members AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS words FROM ids
  UNION ALL
  SELECT conv_id, depth, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)), words FROM rebuilt),
nodes AS MATERIALIZED (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM members GROUP BY depth, prefix),
parents AS MATERIALIZED (
  SELECT n.depth, n.prefix, p.prefix AS parent, q.conv_id AS parent_conv_id
  FROM nodes n JOIN members p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes q ON q.depth = p.depth AND q.prefix = p.prefix),
kids AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM parents GROUP BY ALL),
filled AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, prefix)),
sums AS (
  SELECT m.depth, m.prefix, count_if(f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
  FROM filled f JOIN members m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY m.depth, m.prefix),
last AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
ends AS (
  SELECT depth, prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS names
  FROM last JOIN members USING (conv_id, depth) GROUP BY depth, prefix)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(names, '')) AS ends_sha256
FROM filled JOIN sums USING (depth, prefix) LEFT JOIN parents USING (depth, prefix) LEFT JOIN ends USING (depth, prefix)"""
