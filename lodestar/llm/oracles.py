"""The same results in DuckDB's SQL, written from the definitions."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""

ORACLES["op8_line_dedup"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), told AS (
  SELECT r, host, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM p
), n AS (
  SELECT host, line, count(*) AS n FROM told GROUP BY host, line HAVING count(*) >= 5
), dropped AS (
  SELECT n.host, list(line) AS gone
  FROM n JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) h ON n.host = h.host AND n > 0.02 * pages GROUP BY n.host
), kept AS (
  SELECT doc_id, source, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS stay
  FROM p LEFT JOIN dropped USING (host)
)
SELECT doc_id, source, len(lines) AS n_lines, len(lines) - len(stay) AS n_dropped, array_to_string(stay, chr(10)) AS text FROM kept
"""

ORACLES["op9_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), grams AS (
  SELECT doc_id, i, words[i:i + 2] AS g
  FROM t, unnest(range(1, len(words) - 1)) AS r(i) WHERE len(words) >= 3
), twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS r(k) GROUP BY doc_id
), f AS (
  SELECT t.doc_id, lang, len(words) AS n_words,
    length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS symbol,
    length(regexp_replace(body, '\P{Lu}+', '', 'g')) AS upper,
    length(regexp_replace(body, '\P{Nd}+', '', 'g')) AS digit,
    length(regexp_replace(body, '[^.,;:!?''"()\-]+', '', 'g')) AS mark,
    len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    list_transform(list_filter(words, lambda w: length(w) <= 4), lambda w: lower(w)) AS short
  FROM t LEFT JOIN repeated USING (doc_id)
), g AS (
  SELECT *, [upper, digit, mark, symbol, word_chars - upper - digit - mark - symbol] AS classes FROM f
), word_counts AS (
  SELECT lang, w, count(*) AS n FROM g, unnest(short) AS r(w) GROUP BY lang, w
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) <= 24
), ref_words AS (
  SELECT lang, list(w ORDER BY n DESC, w) AS ws, list(n ORDER BY n DESC, w) AS ns FROM word_counts GROUP BY lang
), ref AS (
  SELECT lang, coalesce(ws, []) AS ws,
    list_transform(list_append(coalesce(ns, []), total - coalesce(list_sum(ns), 0)), lambda n: n / greatest(total, 1)) AS word_q,
    list_transform(sums, lambda n: n / greatest(list_sum(sums), 1)) AS class_q
  FROM (SELECT lang, sum(n_words) AS total,
               [sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5])] AS sums
        FROM g GROUP BY lang) LEFT JOIN ref_words USING (lang)
), h AS (
  SELECT g.*, class_q, word_q,
    list_transform(classes, lambda n: n / greatest(word_chars, 1)) AS class_p,
    list_transform(ws, lambda w: len(list_filter(short, lambda x: x = w))) AS counts
  FROM g JOIN ref USING (lang)
), p AS (
  SELECT *, list_transform(list_append(counts, n_words - coalesce(list_sum(counts), 0)),
                           lambda n: n / greatest(n_words, 1)) AS word_p FROM h
), terms AS (
  SELECT *,
    list_sum(list_transform(list_zip(class_p, class_q), lambda z:
      CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2 AS class_js,
    list_sum(list_transform(list_zip(word_p, word_q), lambda z:
      CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2 AS word_js
  FROM p
), d AS (
  SELECT doc_id, n_words, word_chars, symbol AS n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN round(sqrt(greatest(class_js, 0)), 6) END AS class_distance,
    CASE WHEN n_words >= 100 THEN round(sqrt(greatest(word_js, 0)), 6) END AS word_distance
  FROM terms
)
SELECT *, NOT base_failed AND coalesce(class_distance, 0) <= 0.3 AND coalesce(word_distance, 0) <= 0.35 AS kept FROM d
"""

# crc32 bit by bit; a prefix is written as the digests of its turns, so it is a string prefix of what follows it.
ORACLES["op11_prefix_trie"] = r"""
WITH own AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_id,
    strlen(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)), 4294967295::UBIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), built AS (
  SELECT c.conv_id, 0 AS late, pos, turn_id, size FROM c JOIN own ON own.conv_id = c.base AND pos < h
  UNION ALL
  SELECT c.conv_id, 1, pos, turn_id, size FROM c JOIN own ON own.conv_id = c.conv_id AND pos >= h
), prefixes AS (
  SELECT conv_id, string_agg(turn_id, '') OVER w AS prefix, row_number() OVER w AS depth, size
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY late, pos)
  UNION ALL
  SELECT conv_id, '', 0, 0 FROM c
), lengths AS (
  SELECT conv_id, max(depth) AS longest FROM prefixes GROUP BY ALL
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    substr(prefix, 1, greatest(length(prefix) - 64, 0)) AS parent, max(longest) = depth AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (longest = depth), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY prefix, depth
), below AS (
  SELECT n.prefix, count(*) FILTER (m.leaf) AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens,
    count(*) FILTER (m.depth = n.depth + 1) AS n_children
  FROM nodes n JOIN nodes m ON starts_with(m.prefix, n.prefix) GROUP BY n.prefix
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.parent
"""
