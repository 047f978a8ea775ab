"""DuckDB SQL giving the same rows as each registered query, from the same tables."""

from __future__ import annotations

from lodestar.operators import evaluate, prompts

ORACLES: dict[str, str] = {}

NL = "chr(10)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _lines(x: str) -> str:
    return f"CASE WHEN rtrim({x}, {NL}) = '' AND {x} <> '' THEN []::VARCHAR[] ELSE string_split(rtrim({x}, {NL}), {NL}) END"


def _joined(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda c: c::VARCHAR), ',')"


def _fill(template: str, **values: str) -> str:
    """The template as a SQL concatenation; values are SQL expressions."""
    parts, rest = [], template
    while True:
        at = min(((rest.find(f"<{n}>"), n) for n in values if f"<{n}>" in rest), default=None)
        if at is None:
            break
        pos, name = at
        parts += [_lit(rest[:pos]), f"coalesce({values[name]}, '')"]
        rest = rest[pos + len(name) + 2 :]
    parts.append(_lit(rest))
    return " || ".join(parts)


# ------------------------------------------------------------------ retrieval building blocks


def _cosine(a: str, b: str) -> str:
    cos = f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
    return f"CASE WHEN isnan({cos}) THEN 0.0 ELSE {cos} END"


def _hits(q: str, v: str, k: int) -> str:
    return f"""SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT q.query_id, v.chunk_id, round({_cosine("q.embedding", "v.embedding")}, 10) AS score FROM {q} q CROSS JOIN {v} v))
      WHERE rank <= {k}"""


def _rollup(hits: str, chunks: str) -> str:
    return f"""SELECT query_id, source_id, list(chunk_id ORDER BY chunk_id) AS chunk_ids, greatest(0.0, max(score)) AS score
      FROM {hits} JOIN {chunks} USING (chunk_id) GROUP BY query_id, source_id"""


def _fixed(src: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM {src})
      WHERE rank <= {k}"""


def _adaptive(src: str, k: int) -> str:
    """Follows the definition: the last position where the running cut moved."""
    return f"""SELECT s.*, o.optimal_k FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM {src}) s
      JOIN (SELECT query_id, max(n) AS n, max(CASE WHEN moves THEN rank ELSE 0 END) AS optimal_k FROM (
          SELECT *, score >= 0.6 AND nxt IS NOT NULL OR gap > 0 AND gap > coalesce(max(gap) OVER (PARTITION BY query_id
              ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moves FROM (
            SELECT *, CASE WHEN score < 0.6 AND score >= 0.3 THEN round(score - nxt, 6) END AS gap FROM (
              SELECT query_id, score,
                row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank,
                lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS nxt,
                count(*) OVER (PARTITION BY query_id) AS n FROM {src})))
        GROUP BY query_id) o USING (query_id)
      WHERE s.rank <= least(o.optimal_k + 5, {k}, o.n)"""


def _route(lists: str, requests: str, k: int, part: str = "") -> str:
    """``part`` is an optional extra partition column such as ``grp,``."""
    return f"""SELECT {part} request_id, source_id, query_no, score, chunk_ids, rrf_score, position FROM (
      SELECT *, row_number() OVER (PARTITION BY {part} request_id ORDER BY
          CASE WHEN queries = 1 THEN rank ELSE 0 END, rrf_score DESC, source_id) AS position FROM (
        SELECT {part} l.request_id, source_id, any_value(queries) AS queries,
          CASE WHEN any_value(queries) > 1 THEN round(sum(1.0 / (60 + rank)), 10) END AS rrf_score,
          arg_min(query_no, query_no) AS query_no, arg_min(score, query_no) AS score,
          arg_min(chunk_ids, query_no) AS chunk_ids, arg_min(rank, query_no) AS rank
        FROM {lists} l JOIN (SELECT request_id, count(*) AS queries FROM {requests} GROUP BY request_id) USING (request_id)
        GROUP BY {part} l.request_id, source_id)) WHERE position <= {k}"""


BASE = """q AS MATERIALIZED (SELECT vec_id AS query_id, embedding FROM embeddings),
v AS MATERIALIZED (SELECT vec_id AS chunk_id, embedding FROM embeddings),
c AS (SELECT vec_id AS chunk_id, CAST(floor(vec_id / 4) AS BIGINT) AS source_id FROM embeddings)"""

REQUESTS = """r AS (SELECT vec_id AS query_id, CAST(floor(vec_id / 10) AS BIGINT) * 4 +
    CASE WHEN vec_id % 10 < 1 THEN 0 WHEN vec_id % 10 < 3 THEN 1 WHEN vec_id % 10 < 6 THEN 2 ELSE 3 END AS request_id,
  vec_id % 10 - CASE WHEN vec_id % 10 < 1 THEN 0 WHEN vec_id % 10 < 3 THEN 1 WHEN vec_id % 10 < 6 THEN 3 ELSE 6 END AS query_no
  FROM embeddings)"""

ORACLES["knn_cosine_topk"] = f"WITH {BASE} {_hits('q', 'v', 10)}"
ORACLES["knn_block_grid"] = ORACLES["knn_cosine_topk"]
ORACLES["normalize_vectors"] = """
SELECT chunk_id, dim, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS value FROM (
  SELECT chunk_id, n, generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS x FROM (
    SELECT chunk_id, e, sqrt(list_inner_product(e, e)) AS n FROM (
      SELECT vec_id AS chunk_id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS e FROM embeddings)))"""
ORACLES["hit_sources"] = f"""WITH {BASE}, h AS ({_hits('q', 'v', 25)})
SELECT query_id, chunk_id, source_id, score, rank FROM h JOIN c USING (chunk_id)"""
ORACLES["source_rollup"] = f"""WITH {BASE}, h AS ({_hits('q', 'v', 25)}), s AS ({_rollup('h', 'c')})
SELECT query_id, source_id, {_joined('chunk_ids')} AS chunk_ids, score FROM s"""
ORACLES["fixed_k"] = f"""WITH {BASE}, h AS ({_hits('q', 'v', 40)}), s AS ({_rollup('h', 'c')}), f AS ({_fixed('s', 20)})
SELECT query_id, source_id, {_joined('chunk_ids')} AS chunk_ids, score, rank FROM f"""
ORACLES["adaptive_k"] = f"""WITH {BASE}, h AS ({_hits('q', 'v', 500)}), s AS ({_rollup('h', 'c')}), a AS ({_adaptive('s', 20)})
SELECT query_id, source_id, {_joined('chunk_ids')} AS chunk_ids, score, rank, optimal_k FROM a"""
ORACLES["adaptive_k_scores"] = f"""WITH s AS (SELECT user_id AS query_id, event_id AS source_id,
  round(least(1.0, value / 100), 6) AS score FROM events) {_adaptive('s', 20)}"""
ORACLES["rrf_fusion"] = f"""WITH {BASE}, {REQUESTS}, h AS ({_hits('q', 'v', 40)}), s AS ({_rollup('h', 'c')}),
f AS ({_fixed('s', 20)}), l AS (SELECT f.*, r.request_id, r.query_no FROM f JOIN r USING (query_id)),
g AS (SELECT request_id, source_id, round(sum(1.0 / (60 + rank)), 10) AS rrf_score, min(query_no) AS query_no,
  arg_min(score, query_no) AS score, arg_min(chunk_ids, query_no) AS chunk_ids FROM l GROUP BY ALL)
SELECT request_id, source_id, query_no, score, {_joined('chunk_ids')} AS chunk_ids, rrf_score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rrf_score DESC, source_id) AS position FROM g) WHERE position <= 20"""
_ROUTED = """SELECT request_id, source_id, query_no, score, {ids} AS chunk_ids, rrf_score, position FROM ({route})"""
ORACLES["fusion_route"] = f"""WITH {BASE}, {REQUESTS}, h AS ({_hits('q', 'v', 40)}), s AS ({_rollup('h', 'c')}),
f AS ({_fixed('s', 20)}), l AS (SELECT f.*, r.request_id, r.query_no FROM f JOIN r USING (query_id))
{_ROUTED.format(ids=_joined('chunk_ids'), route=_route('l', 'r', 20))}"""
ORACLES["retrieval_flagship"] = f"""WITH {BASE}, {REQUESTS}, h AS ({_hits('q', 'v', 500)}), s AS ({_rollup('h', 'c')}),
f AS ({_adaptive('s', 20)}), l AS (SELECT f.*, r.request_id, r.query_no FROM f JOIN r USING (query_id))
{_ROUTED.format(ids=_joined('chunk_ids'), route=_route('l', 'r', 20))}"""
ORACLES["truncate_query"] = """SELECT doc_id, text AS query, substr(text, 1, 8000) AS embedding_text,
  length(text) > 8000 AS truncated FROM documents"""

# ------------------------------------------------------------------ index tables

TYPED = """t AS (SELECT vec_id AS chunk_id, (['CODE', 'ENRICHMENT', 'DOCUMENT', 'UNDEFINED'])[label % 4 + 1] AS content_type, embedding
  FROM embeddings)"""
ORACLES["type_filter"] = f"WITH {TYPED} SELECT chunk_id, content_type FROM t WHERE content_type IN ('CODE', 'DOCUMENT')"
ORACLES["load_counts"] = f"""WITH {TYPED} SELECT index_name, content_type, count(*) AS n_chunks FROM (
  SELECT 'full' AS index_name, content_type FROM t WHERE content_type <> 'UNDEFINED'
  UNION ALL SELECT 'plain', content_type FROM t WHERE content_type IN ('CODE', 'DOCUMENT')) GROUP BY ALL"""
ORACLES["index_ensure"] = """SELECT index_name FROM (VALUES ('full'), ('index-1')) w(index_name)
WHERE index_name NOT IN (SELECT 'index-' || label FROM embeddings)"""
ORACLES["index_members"] = f"""WITH {TYPED} SELECT w.index_name, t.chunk_id FROM t JOIN documents d ON d.doc_id = t.chunk_id
CROSS JOIN (VALUES ('index-1'), ('absent')) w(index_name)
WHERE w.index_name IN (SELECT 'index-' || label FROM embeddings) AND NOT (w.index_name = 'index-1' AND content_type = 'CODE')"""

# ------------------------------------------------------------------ extraction

DOC_LINES = f"""SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, {_lines('text')} AS ls FROM documents)"""


def _packed(parts: str, keys: str, sep: str, limit: int) -> str:
    """Recursive greedy packing of ``parts(keys..., i, line)``, i from 1 per key."""
    same = " AND ".join(f"f.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    full = f"f.used + length(p.line) > {limit}"
    prefixed = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    n = 1 if sep == "' '" else 2
    return f"""p AS MATERIALIZED ({parts}),
f AS (SELECT {keys}, i, 0 AS ordinal, length(line) + {n} AS used FROM p WHERE i = 1
  UNION ALL SELECT {prefixed}, p.i, CASE WHEN {full} THEN f.ordinal + 1 ELSE f.ordinal END,
    length(p.line) + {n} + CASE WHEN {full} THEN 0 ELSE f.used END
  FROM f JOIN p ON {same} AND p.i = f.i + 1),
k AS (SELECT {prefixed}, ordinal, {_trim(f"string_agg(line || {sep}, '' ORDER BY p.i)")} AS content
  FROM f JOIN p ON {same} AND p.i = f.i GROUP BY {prefixed}, ordinal)"""


ORACLES["pack_lines"] = f"""WITH RECURSIVE {_packed(DOC_LINES, 'doc_id', "' '", 3000)}
SELECT 'pdf::' || doc_id AS source_name, ordinal, 'pdf::' || doc_id || '::' || ordinal AS paragraph_name, content FROM k"""


def _sections(limit: int) -> str:
    shaped = f"""SELECT doc_id, i, {_trim('line')} AS title, (i - 1) % 7 AS shape,
      count(*) FILTER ((i - 1) % 7 = 1) OVER (PARTITION BY doc_id ORDER BY i) AS l1,
      count(*) FILTER ((i - 1) % 7 = 1) OVER (PARTITION BY doc_id) AS n1, line FROM ({DOC_LINES})"""
    nested = """SELECT *, count(*) FILTER (shape = 3) OVER (PARTITION BY doc_id, l1 ORDER BY i) AS l2,
      count(*) FILTER (shape = 3) OVER (PARTITION BY doc_id, l1) AS n2,
      max(CASE WHEN shape = 1 THEN title END) OVER (PARTITION BY doc_id, l1) AS t1 FROM shaped"""
    placed = f"""SELECT *, CASE WHEN l1 = 0 THEN n1 ELSE l1 - 1 END AS s1, CASE WHEN l1 = 0 THEN 0 WHEN l2 = 0 THEN n2 ELSE l2 - 1 END AS s2,
      CASE WHEN l2 > 0 THEN max(CASE WHEN shape = 3 THEN title END) OVER (PARTITION BY doc_id, l1, l2) END AS t2,
      CASE shape WHEN 5 THEN title || {NL} WHEN 6 THEN '== ' || line || {NL} || {NL} || 'x' ELSE title END AS block
      FROM nested"""
    blocks = """SELECT doc_id, s1, s2, row_number() OVER (PARTITION BY doc_id, s1, s2 ORDER BY i) AS i, block AS line
      FROM placed WHERE shape NOT IN (1, 3) AND title <> ''"""
    return f"""WITH RECURSIVE shaped AS ({shaped}), nested AS ({nested}), placed AS ({placed}),
{_packed(blocks, 'doc_id, s1, s2', f"{NL} || {NL}", limit)},
names AS (SELECT DISTINCT doc_id, s1, s2, t1, t2 FROM placed WHERE shape NOT IN (1, 3))
SELECT 'asciidoc::' || doc_id AS source_name, s1 AS section_1, s2 AS section_2, ordinal,
  concat_ws('::', 'asciidoc', doc_id, t1, t2, ordinal) AS paragraph_name, content FROM k JOIN names USING (doc_id, s1, s2)"""


ORACLES["sections"] = _sections(3000)
ORACLES["pack_blocks"] = _sections(400)

JAVA = """java AS (SELECT 'cu::Part' || p_partkey || '.java' AS source_name, p_type, p_size, p_partkey,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE 'com.' || lower(replace(p_brand, '#', '')) END AS package,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS name FROM part)"""
DECLARED = f"""{JAVA}, declared AS (
  SELECT source_name, 0 AS pos, package || '.' || name AS signature, '/** A {{ part. */' || {NL} || 'public class ' || name || ' {{' || {NL} ||
    '  String type = "class ' || p_type || ' {{";' || {NL} || '  enum Size {{ S' || p_size || ' }}' || {NL} ||
    '  record Price(double value) {{}}' || {NL} || '}}' AS content FROM java
  UNION ALL SELECT source_name, 1, package || '.Size', 'enum Size {{ S' || p_size || ' }}' FROM java
  UNION ALL SELECT source_name, 2, package || '.Price', 'record Price(double value) {{}}' FROM java)"""
DECLARED = DECLARED.replace("{{", "{").replace("}}", "}")
ORACLES["type_declarations"] = f"WITH {DECLARED} SELECT source_name, pos, signature, content, true AS parsed FROM declared"
ORACLES["type_signature"] = f"WITH {JAVA} SELECT source_name, package || '.' || name AS signature FROM java"
ORACLES["source_identity"] = f"""WITH RECURSIVE {DECLARED}, plain AS (SELECT * FROM ({ORACLES["pack_lines"]})),
cut AS (SELECT * FROM ({ORACLES["sections"]})),
sources AS (SELECT 'node' AS kind, source_name, signature AS name FROM declared
  UNION ALL SELECT 'paragraph', source_name, paragraph_name FROM plain
  UNION ALL SELECT 'paragraph', source_name, paragraph_name FROM cut)
SELECT kind, source_name, name, 2 * count(*) AS n_rows, 2 * count(*) AS n_ids FROM sources GROUP BY ALL"""
ORACLES["extract_counts"] = f"""WITH RECURSIVE {DECLARED}, {_packed(DOC_LINES, 'doc_id', "' '", 3000)}
SELECT source_name, kind, count(*) AS n_rows FROM (SELECT source_name, 'class_node' AS kind FROM declared
  UNION ALL SELECT 'pdf::' || doc_id, 'paragraph' FROM k) GROUP BY ALL"""
ORACLES["signature_keywords"] = f"""WITH {DECLARED} SELECT source_name, pos, signature,
  string_split(signature, '.')[-1] AS class_name, string_split(signature, '.')[-2] AS package_name FROM declared"""

HUNKS = f"""SELECT doc_id, i, 'new/f' || (i - 1) || '.txt' AS filepath,
  '@@ -1 +1 @@' || {NL} || '-x' || {NL} || '+' || line || {NL} AS content FROM ({DOC_LINES}) WHERE (i - 1) % 3 <> 2"""
ORACLES["split_diff"] = f"""SELECT doc_id::VARCHAR AS pr_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos,
  filepath, content FROM ({HUNKS})"""
ORACLES["attach_hunks"] = f"""SELECT doc_id::VARCHAR AS id, 'PR ' || doc_id AS title, coalesce(hunks, '') AS hunks FROM labels
LEFT JOIN (SELECT doc_id, string_agg(filepath || '=' || content, '|' ORDER BY i) AS hunks FROM ({HUNKS}) GROUP BY doc_id) USING (doc_id)"""
ORACLES["source_name"] = """SELECT page_id, 'markdown::' || CASE WHEN string_split(url, '/')[-1] = '' THEN 'unknown'
  ELSE string_split(url, '/')[-1] END AS source_name FROM pages"""
ORACLES["document_kind"] = """SELECT path, CASE WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.adoc' THEN 'asciidoc'
  WHEN lower(path) LIKE '%.pdf' THEN 'pdf' ELSE 'unsupported file type' END AS source_type
FROM (SELECT url || (['.md', '.ADOC', '.pdf', '.txt', ''])[page_id % 5 + 1] AS path FROM pages)"""

# ------------------------------------------------------------------ chunking

ORACLES["clean_text"] = f"""SELECT doc_id, regexp_replace(regexp_replace(chr(7) || replace(text, ' ', ' ' || chr(31)) || chr(9) || '_serializedATN =' || {NL} || '  "' || text ||
    '";' || chr(13) || {NL} || 'end' || chr(127), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'),
    '_serializedATN\\s*=\\s*"(?s:.*?)";', '_serializedATN = "<ANTLR_SERIALIZED_ATN>";', 'g') AS content FROM documents"""
ORACLES["content_type"] = """SELECT doc_id, CASE WHEN source = 'src1' THEN 'CODE' WHEN source = 'src2' THEN 'DOCUMENT'
  ELSE 'UNDEFINED' END AS content_type FROM documents"""
UNPIVOTED = """SELECT 'n' || doc_id AS source_id, text_no, content_type, content FROM documents JOIN labels USING (doc_id),
  LATERAL (VALUES (0, 'CODE', text), (1, 'ENRICHMENT', 'in ' || lang),
    (2, 'ENRICHMENT', CASE WHEN toxic = 0 THEN 'from ' || source END), (3, 'ENRICHMENT', n_chars::VARCHAR)) x(text_no, content_type, content)
  WHERE quality = 1 UNION ALL SELECT 'p' || doc_id, 0, 'DOCUMENT', text FROM documents"""
ORACLES["chunk_unpivot"] = UNPIVOTED


def _cut(text: str, size: int) -> str:
    return f"regexp_extract_all({text}, '(?:[^ \\t\\r\\n\\f]+[ \\t\\r\\n\\f]*){{1,{size}}}')"


ORACLES["split_tokens"] = f"""SELECT source_id, chunk_no, regexp_replace(piece, '[\\x00-\\x20]+$', '') AS content FROM (
  SELECT 'p' || doc_id AS source_id, generate_subscripts(c, 1) - 1 AS chunk_no, unnest(c) AS piece
  FROM (SELECT doc_id, {_cut('text', 50)} AS c FROM documents))"""
ORACLES["split_tokens_wide"] = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\r\\n\\f]+[ \\t\\r\\n\\f]*') AS ts FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(ts), 1500)) AS i, ts FROM w)
SELECT 'p' || doc_id AS source_id, i // 1500 AS chunk_no,
  regexp_replace(array_to_string(ts[i + 1:i + 1500], ''), '[\\x00-\\x20]+$', '') AS content FROM p"""
ORACLES["chunk_counts"] = f"""SELECT source_id, sum(n)::BIGINT AS n_chunks FROM (
  SELECT source_id, len({_cut("coalesce(content, '')", 100)}) AS n FROM ({UNPIVOTED})) GROUP BY source_id HAVING sum(n) > 0"""

# ------------------------------------------------------------------ binding and enrichment

NODES = """words AS (SELECT item_id, text, list_filter(string_split_regex(text, '[^\\p{L}]+'), lambda w: w <> '') AS w FROM benchmark),
nodes AS (SELECT item_id || '-' || (nth - 1) AS node_id, text AS content,
    CASE WHEN nth = 1 THEN '' ELSE lower(w[nth - 1]) END AS b, lower(w[nth]) AS a
  FROM words, LATERAL (SELECT unnest(generate_series(1, len(w))) AS nth)),
pairs AS (SELECT DISTINCT a, b FROM nodes),
low AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents),
word AS (SELECT DISTINCT unnest([a, b]) AS word FROM nodes),
found AS MATERIALIZED (SELECT word, doc_id FROM word JOIN low ON contains(t, word)),
m AS (SELECT a, b, doc_id, count(*) = CASE WHEN a = b THEN 1 ELSE 2 END AS matches_all
  FROM (SELECT a, b, unnest(list_distinct([a, b])) AS word FROM pairs) JOIN found USING (word) GROUP BY a, b, doc_id),
n AS (SELECT *, count(*) OVER (PARTITION BY a, b) <= 10 AS fits, row_number() OVER (PARTITION BY a, b ORDER BY doc_id) AS any_no,
  count(*) FILTER (matches_all) OVER (PARTITION BY a, b) AS n_all FROM m)"""
CHOSEN = """chosen AS (SELECT a, b, doc_id, matches_all, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY CASE WHEN fits OR matches_all THEN 0 ELSE 1 END, doc_id) - 1 AS pos FROM n)
  WHERE pos < 10)"""
BOUND = f"{NODES}, {CHOSEN}"
ORACLES["keyword_bind"] = f"WITH {BOUND} SELECT node_id, doc_id AS paragraph_id, pos, matches_all FROM nodes JOIN chosen USING (a, b)"
ORACLES["keyword_bind_grams"] = ORACLES["keyword_bind"]  # another way to the same rows
ORACLES["incremental_bind"] = ORACLES["keyword_bind"]  # an update gives what a fresh binding gives
ORACLES["keyword_bind_repeat"] = f"""WITH {NODES}, taken AS (
  SELECT a, b, doc_id, matches_all, 0 AS tier FROM n WHERE fits OR matches_all
  UNION ALL SELECT a, b, doc_id, matches_all, 1 FROM n WHERE NOT fits AND any_no <= 10 - least(n_all, 10))
SELECT node_id, doc_id AS paragraph_id, pos, matches_all FROM nodes JOIN (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY tier, doc_id) - 1 AS pos FROM taken) USING (a, b) WHERE pos < 10"""
ORACLES["keyword_bind_counts"] = f"""WITH {BOUND} SELECT node_id, count(doc_id) AS n_paragraphs
FROM nodes LEFT JOIN chosen USING (a, b) GROUP BY node_id"""
ENRICHMENT = f"""{BOUND}, texts AS (SELECT node_id, string_agg(d.text, {NL} ORDER BY pos) AS doc
  FROM nodes JOIN chosen USING (a, b) JOIN documents d USING (doc_id) GROUP BY node_id),
asked AS (SELECT node_id, {_fill(prompts.ENRICHMENT_PROMPT, code='content', doc='doc', format=_lit(prompts.SUMMARY_FORMAT))} AS prompt
  FROM nodes LEFT JOIN texts USING (node_id))"""
ORACLES["prompt_enrichment"] = f"WITH {ENRICHMENT} SELECT node_id, prompt FROM asked"
ORACLES["enrich_nodes"] = f"""WITH {ENRICHMENT} SELECT node_id,
  CASE WHEN length(prompt) % 2 = 0 THEN '' ELSE 'about ' END || length(prompt) AS description,
  CASE WHEN length(prompt) % 2 = 0 THEN 'u' ELSE 'null' END AS "usage",
  CASE WHEN length(prompt) % 2 = 0 THEN 'r' ELSE 'null' END AS relationship, true AS processed FROM asked"""
ORACLES["unprocessed_anti"] = """SELECT doc_id AS node_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
ORACLES["parse_summary"] = """SELECT event_id,
  CASE event_type WHEN 'click' THEN 'd' || k WHEN 'view' THEN 'd' WHEN 'purchase' THEN k WHEN 'signup' THEN 'no json ' || k
    ELSE '{"description":"' || k END AS description,
  CASE event_type WHEN 'click' THEN 'u' WHEN 'view' THEN 'e' || k WHEN 'purchase' THEN 'f' ELSE 'null' END AS "usage",
  CASE event_type WHEN 'click' THEN 'r' WHEN 'view' THEN NULL WHEN 'purchase' THEN 'r' ELSE 'null' END AS relationship
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)"""

# ------------------------------------------------------------------ prompts

PRS = f"""prs AS (SELECT conv_id || '-' || turn AS request_id, ls[1] AS description,
  list_transform(ls[2:], lambda line, i: '{{"filepath: src/F' || (i - 1) || '.java", "content": "' || line || '"}}') AS hunks
  FROM (SELECT *, {_lines('text')} AS ls FROM conversations))"""
ORACLES["queries_answer"] = "SELECT item_id::VARCHAR AS request_id, 0 AS query_no, text AS query FROM benchmark"
_INTERPRETATION = f"""SELECT request_id, generate_subscripts(hunks, 1) - 1 AS query_no,
  {_lit(prompts.INTERPRETATION_QUERY)} || unnest(hunks) AS query FROM prs"""
_REVIEW = f"""SELECT request_id, generate_subscripts(qs, 1) - 1 AS query_no, unnest(qs) AS query FROM (SELECT request_id,
  list_concat([description], list_transform(hunks, lambda h: {_lit(prompts.REVIEW_QUERY)} || h)) AS qs FROM prs)"""
ORACLES["hunk_queries_interpretation"] = f"WITH {PRS} {_INTERPRETATION}"
ORACLES["hunk_queries_review"] = f"WITH {PRS} {_REVIEW}"
_CONTEXT = f"string_agg(place || '. ' || text || {NL}, '' ORDER BY place)"
_NUMBERED = f"array_to_string(list_transform(hunks, lambda h, i: i || '. ' || h || {NL}), '')"
ORACLES["prompt_answer"] = f"""WITH n AS (SELECT count(*) AS n FROM benchmark),
d AS (SELECT doc_id, text, doc_id % n AS item_id, doc_id // n + 1 AS place FROM documents, n),
ctx AS (SELECT item_id, {_CONTEXT} AS context FROM d GROUP BY item_id)
SELECT item_id::VARCHAR AS request_id, {_fill(prompts.ANSWER_PROMPT, query='text', context='context')} AS prompt
FROM benchmark LEFT JOIN ctx USING (item_id)"""
_TURNS = f"""n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
d AS (SELECT text, doc_id % n || '-' || doc_id // n % 2 AS request_id, doc_id // (2 * n) + 1 AS place FROM documents, n),
ctx AS (SELECT request_id, {_CONTEXT} AS context FROM d GROUP BY request_id)"""
ORACLES["prompt_interpretation"] = f"""WITH {PRS}, {_TURNS} SELECT request_id,
  {_fill(prompts.INTERPRETATION_PROMPT, hunks=_NUMBERED, context='context')} AS prompt FROM prs LEFT JOIN ctx USING (request_id)"""
ORACLES["prompt_review"] = f"""WITH {PRS}, {_TURNS} SELECT request_id,
  {_fill(prompts.REVIEW_PROMPT, description='description', hunks=_NUMBERED, context='context')} AS prompt
  FROM prs LEFT JOIN ctx USING (request_id)"""

# ------------------------------------------------------------------ whole runs


def _letters(x: str) -> str:
    return "[" + ", ".join(f"length({x}) - length(replace({x}, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


ORACLES["embed_texts"] = f"""SELECT paragraph_id, generate_subscripts(e, 1) - 1 AS dim, unnest(e)::FLOAT AS value FROM (
  SELECT paragraph_id, {_letters('t')} AS e FROM (SELECT doc_id AS paragraph_id, lower(text) AS t FROM documents))"""

CORPUS = f"""pieces AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS chunk_no, lower(unnest(c)) AS t
  FROM (SELECT doc_id, {_cut('text', 200)} AS c FROM documents)),
chunks AS MATERIALIZED (SELECT doc_id * 1000 + chunk_no AS chunk_id, doc_id AS source_id, {_letters('t')} AS embedding FROM pieces),
plain AS (SELECT * FROM chunks WHERE source_id % 3 <> 0)"""


def _run(task: str, queries: str, inputs: str, template: str, values: dict[str, str], groups: list[str]) -> list[str]:
    """CTEs of one task: its queries, hits, lists per group, prompts."""
    t = task
    plan = {
        "adaptive_full": (f"{t}_full", 500, _adaptive),
        "simple_full": (f"{t}_full", 40, _fixed),
        "adaptive_plain": (f"{t}_plain", 500, _adaptive),
    }
    ctes = [
        f"{t}_r AS MATERIALIZED (SELECT request_id, query_no, request_id || '#' || query_no AS query_id, {_letters('t')} AS embedding "
        f"FROM (SELECT request_id, query_no, lower(substr(query, 1, 8000)) AS t FROM ({queries})))",
        f"{t}_full AS MATERIALIZED ({_hits(f'{t}_r', 'chunks', 500)})",
    ]
    if "adaptive_plain" in groups:
        ctes.append(f"{t}_plain AS MATERIALIZED ({_hits(f'{t}_r', 'plain', 500)})")
    for g in groups:
        source, fetch, cut = plan[g]
        near = f"(SELECT * FROM {source} WHERE rank <= {fetch})"
        ctes.append(f"{t}_{g}_s AS MATERIALIZED ({_rollup(near, 'chunks')})")
        kept = cut(f"{t}_{g}_s", 20)
        ctes.append(
            f"{t}_{g}_l AS (SELECT '{g}' AS grp, x.query_id, x.source_id, x.chunk_ids, x.score, x.rank, r.request_id, r.query_no "
            f"FROM ({kept}) x JOIN {t}_r r USING (query_id))"
        )
        ctes.append(f"{t}_{g}_f AS MATERIALIZED ({_route(f'{t}_{g}_l', f'{t}_r', 20, 'grp,')})")
    union = " UNION ALL ".join(f"SELECT * FROM {t}_{g}_f" for g in groups)
    ctes.append(
        f"{t}_d AS (SELECT grp, request_id, string_agg(source_id || ':' || array_to_string(chunk_ids::VARCHAR[], '+'), ',' ORDER BY position) AS documents, "
        f"string_agg(position || '. ' || d.text || {NL}, '' ORDER BY position) AS context "
        f"FROM ({union}) u JOIN documents d ON d.doc_id = u.source_id GROUP BY ALL)"
    )
    names = ", ".join(f"('{g}')" for g in groups)
    prompt = _fill(template, context="context", **values)
    ctes.append(
        f"{t}_out AS (SELECT '{t}' AS task, g.grp AS \"group\", i.request_id, coalesce(documents, '') AS documents, "
        f"length({prompt}) || ' characters' AS response, NULL::VARCHAR AS error "
        f"FROM ({inputs}) i CROSS JOIN (VALUES {names}) g(grp) LEFT JOIN {t}_d d ON d.grp = g.grp AND d.request_id = i.request_id)"
    )
    return ctes


_QA = ("query_answer", ORACLES["queries_answer"], ORACLES["queries_answer"], prompts.ANSWER_PROMPT, {"query": "query"})
_CI = ("code_interpretation", _INTERPRETATION, "SELECT * FROM prs", prompts.INTERPRETATION_PROMPT, {"hunks": _NUMBERED})
_CR = ("code_review", _REVIEW, "SELECT * FROM prs", prompts.REVIEW_PROMPT, {"description": "description", "hunks": _NUMBERED})
ORACLES["answer_questions"] = f"WITH {CORPUS}, {', '.join(_run(*_QA, ['adaptive_full']))} SELECT * FROM query_answer_out"
_ALL = [g[0] for g in evaluate.GROUPS]
ORACLES["evaluation_runs"] = f"""WITH {CORPUS}, {PRS}, {', '.join(_run(*_QA, _ALL) + _run(*_CI, _ALL) + _run(*_CR, _ALL))}
SELECT * FROM query_answer_out UNION ALL SELECT * FROM code_interpretation_out UNION ALL SELECT * FROM code_review_out"""

# The built-in embedder: tf-idf over 128 buckets, the number in the first eight hex digits of a token's MD5 modulo 128.
ORACLES["hashed_embedding_search"] = f"""WITH texts AS (
  SELECT 'd' AS kind, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'q', item_id::VARCHAR, text FROM benchmark),
tokens AS (SELECT kind, id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 128 AS bucket
  FROM (SELECT kind, id, unnest(string_split_regex(lower(coalesce(text, '')), '\\W+')) AS t FROM texts) WHERE t <> ''),
tf AS (SELECT kind, id, bucket, count(*) AS n FROM tokens GROUP BY ALL),
idf AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS w FROM tf WHERE kind = 'd' GROUP BY bucket),
cells AS (SELECT kind, id, bucket, n * coalesce(w, ln((SELECT count(*) FROM documents) + 1)) AS x FROM tf LEFT JOIN idf USING (bucket)),
whole AS (SELECT kind, id, b AS bucket FROM (SELECT DISTINCT kind, id FROM texts), range(128) r(b)),
vecs AS MATERIALIZED (SELECT kind, id, list(coalesce(x, 0.0) ORDER BY bucket) AS embedding
  FROM whole LEFT JOIN cells USING (kind, id, bucket) GROUP BY kind, id),
q AS MATERIALIZED (SELECT id AS query_id, embedding FROM vecs WHERE kind = 'q'),
v AS MATERIALIZED (SELECT id::BIGINT AS chunk_id, embedding FROM vecs WHERE kind = 'd')
{_hits('q', 'v', 10)}"""

# ------------------------------------------------------------------ evaluation

RESULTS = f"""q AS MATERIALIZED (SELECT vec_id AS query_id, embedding FROM embeddings), {TYPED},
c AS (SELECT vec_id AS chunk_id, CAST(floor(vec_id / 4) AS BIGINT) AS source_id FROM embeddings),
vf AS (SELECT * FROM t WHERE content_type <> 'UNDEFINED'), vp AS (SELECT * FROM t WHERE content_type IN ('CODE', 'DOCUMENT')),
hf AS MATERIALIZED ({_hits('q', 'vf', 500)}), hp AS MATERIALIZED ({_hits('q', 'vp', 500)}),
sa AS MATERIALIZED ({_rollup('hf', 'c')}), ss AS MATERIALIZED ({_rollup('(SELECT * FROM hf WHERE rank <= 40)', 'c')}),
sp AS MATERIALIZED ({_rollup('hp', 'c')}),
found AS (SELECT 'adaptive_full' AS "group", query_id, source_id, score, rank FROM ({_adaptive('sa', 20)})
  UNION ALL SELECT 'simple_full', query_id, source_id, score, rank FROM ({_fixed('ss', 20)})
  UNION ALL SELECT 'adaptive_plain', query_id, source_id, score, rank FROM ({_adaptive('sp', 20)})),
labelled AS (SELECT f.*, e.label FROM found f JOIN embeddings e ON e.vec_id = f.query_id
  WHERE e.label <> 0 OR "group" <> 'adaptive_plain'),
listed AS MATERIALIZED (SELECT 'query_answer' AS task, "group", query_id AS item_id, copy AS result_no, rank AS position,
    's' || (source_id % 60) AS source_name, score AS similarity_score
  FROM labelled, (VALUES (0), (1)) x(copy)
  WHERE copy = 0 OR label = 1 AND "group" = 'simple_full' AND rank <= 3),
res AS (SELECT DISTINCT task, "group", item_id, result_no FROM listed),
sets AS (SELECT item_id, "group", list_sort(list(DISTINCT source_name)) AS names FROM listed l
  WHERE result_no = (SELECT max(result_no) FROM res WHERE res.item_id = l.item_id AND res."group" = l."group") GROUP BY ALL),
cmp AS (SELECT i.item_id, p.g1 AS group_1, p.g2 AS group_2, a.names AS n1, b.names AS n2,
    CASE WHEN a.names IS NULL THEN p.g1 WHEN b.names IS NULL THEN p.g2 END AS missing
  FROM (SELECT item_id FROM res GROUP BY item_id HAVING count(*) > 1) i
  CROSS JOIN (VALUES ('adaptive_full', 'adaptive_plain'), ('adaptive_full', 'simple_full')) p(g1, g2)
  LEFT JOIN sets a ON a.item_id = i.item_id AND a."group" = p.g1 LEFT JOIN sets b ON b.item_id = i.item_id AND b."group" = p.g2)"""
ORACLES["eval_matrix"] = """SELECT task, item_id, g."group", strategy, k, index_name FROM (
  SELECT 'code_review' AS task, conv_id || '-' || turn AS item_id FROM conversations
  UNION ALL SELECT 'query_answer', item_id::VARCHAR FROM benchmark)
CROSS JOIN (VALUES ('adaptive_full', 'adaptive', 20, 'full'), ('simple_full', 'fixed', 20, 'full'),
  ('adaptive_plain', 'adaptive', 20, 'plain')) g("group", strategy, k, index_name)"""
ORACLES["eval_items"] = f"""WITH {RESULTS} SELECT task, item_id, count(*) AS n_results, count(DISTINCT "group") AS n_groups FROM res GROUP BY ALL"""
ORACLES["eval_listing"] = f"""WITH {RESULTS} SELECT task, "group", item_id, position, source_name, similarity_score FROM listed"""
ORACLES["group_jaccard"] = f"""WITH {RESULTS}, sizes AS (SELECT *, len(list_intersect(n1, n2)) AS n_both,
    len(n1) + len(n2) - len(list_intersect(n1, n2)) AS n_either FROM cmp)
SELECT 'query_answer' AS task, item_id, group_1, group_2, CASE WHEN missing IS NULL THEN n_both END AS n_both,
  CASE WHEN missing IS NULL THEN n_either END AS n_either,
  CASE WHEN missing IS NULL THEN round(n_both / n_either, 6) END AS jaccard, missing FROM sizes"""
ORACLES["compare_missing_group"] = f"""WITH {RESULTS} SELECT 'query_answer' AS task, item_id, group_1, group_2, missing FROM cmp
WHERE missing IS NOT NULL"""
ORACLES["only_in_group"] = f"""WITH {RESULTS}, ok AS (SELECT * FROM cmp WHERE missing IS NULL)
SELECT 'query_answer' AS task, item_id, group_1, group_2, group_1 AS only_in, unnest(list_filter(n1, lambda s: NOT list_contains(n2, s))) AS source_name FROM ok
UNION ALL SELECT 'query_answer', item_id, group_1, group_2, group_2, unnest(list_filter(n2, lambda s: NOT list_contains(n1, s))) FROM ok"""
_SPREAD = """round(avg(CAST(round(similarity_score * 1e6) AS BIGINT))) / 1e6 AS avg_similarity, round(min(similarity_score), 6) AS min_similarity,
  round(max(similarity_score), 6) AS max_similarity"""
ORACLES["item_stats"] = f"""WITH {RESULTS} SELECT task, "group", item_id, count(*) AS n_documents, {_SPREAD} FROM listed GROUP BY ALL"""
ORACLES["group_stats"] = f"""WITH {RESULTS} SELECT task, "group", count(DISTINCT item_id) AS n_items, count(*) AS n_documents,
  count(DISTINCT source_name) AS n_unique, {_SPREAD}, round(count(*) / count(DISTINCT item_id), 6) AS documents_per_item
FROM listed GROUP BY ALL"""

NUMBERED = """numbered AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pair_id, doc_id AS result_no,
  (['adaptive_full', 'simple_full', 'adaptive_plain'])[doc_id % 3 + 1] AS "group", source,
  CASE WHEN doc_id % 7 <> 3 THEN text END AS text FROM documents)"""
ORACLES["pair_ids"] = f"""WITH {NUMBERED} SELECT pair_id, result_no, "group" FROM numbered"""
_PAIRS = """to_json(list({'pair_id': pair_id, 'question': 'about ' || source, 'answer': text} ORDER BY pair_id))::VARCHAR"""
ORACLES["judge_prompts_answers"] = f"""WITH {NUMBERED}, b AS (SELECT {_PAIRS} AS pairs FROM numbered)
SELECT 0::BIGINT AS batch, {_fill(evaluate.ANSWER_JUDGE, project="'the project'", qa_pair='pairs')} AS prompt FROM b"""
ORACLES["judge_prompts_batches"] = f"""WITH {NUMBERED}, b AS (SELECT CAST(floor(pair_id / 10) AS BIGINT) AS batch, {_PAIRS} AS pairs
  FROM numbered GROUP BY 1) SELECT batch, {_fill(evaluate.ANSWER_JUDGE, project="'the project'", qa_pair='pairs')} AS prompt FROM b"""
_DESCRIBED = """to_json(list({'pair_id': pair_id, 'description': text} ORDER BY pair_id))::VARCHAR"""
_PR_JSON = """'{"id":"' || pr_id || '","title":"title ' || pr_id || '","description":"d","hunks":[{"filepath":"f","content":"+x"}]}'"""
ORACLES["judge_prompts_descriptions"] = f"""WITH {NUMBERED}, b AS (SELECT source AS pr_id, {_DESCRIBED} AS ds FROM numbered GROUP BY source)
SELECT pr_id, {_fill(evaluate.DESCRIPTION_JUDGE, project="'the project'", pull_request=_PR_JSON, generated_descriptions='ds')} AS prompt FROM b"""
def _fragments(sets: str, item: str, head: str, tail: str) -> str:
    """The placed fragments of each set: head, items from 1 on, tail; ``sets`` is a column list, or empty for one set."""
    by = f"PARTITION BY {sets}" if sets else ""
    key, using = (f"{sets} AS pr_id, ", f"USING ({sets})") if sets else ("", "ON true")
    cols = f"{sets}, " if sets else ""
    return f"""items AS (SELECT {cols}pair_id, {item} AS item FROM numbered),
placed AS (SELECT {cols}item, row_number() OVER ({by} ORDER BY pair_id) AS part,
  coalesce(sum(length(item) + 1) OVER ({by} ORDER BY pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM items),
whole AS (SELECT {cols}max(part) AS n, sum(length(item) + 1) AS size FROM placed {"GROUP BY " + sets if sets else "HAVING count(*) > 0"}),
heads AS (SELECT *, {head} AS head FROM whole)
SELECT {key}0::BIGINT AS part, 0::BIGINT AS start, head AS fragment FROM heads
UNION ALL SELECT {key}part, CAST(length(head) + before AS BIGINT), CASE WHEN part = 1 THEN '[' ELSE ',' END || item FROM placed JOIN heads {using}
UNION ALL SELECT {key}n + 1, CAST(length(head) + size AS BIGINT), ']' || {tail} FROM heads"""


_HEAD, _TAIL = (_fill(t, project="'the project'") for t in evaluate.ANSWER_JUDGE.split("<qa_pair>"))
_ANSWER = """to_json({'pair_id': pair_id, 'question': 'about ' || source, 'answer': text})::VARCHAR"""
ORACLES["judge_fragments_answers"] = f"WITH {NUMBERED}, " + _fragments("", _ANSWER, _HEAD, _TAIL)
_BEFORE, _AFTER = evaluate.DESCRIPTION_JUDGE.split("<generated_descriptions>")
ORACLES["judge_fragments_descriptions"] = f"WITH {NUMBERED}, " + _fragments(
    "source",
    "to_json({'pair_id': pair_id, 'description': text})::VARCHAR",
    _fill(_BEFORE, project="'the project'", pull_request=_PR_JSON.replace("pr_id", "source")),
    _fill(_AFTER, project="'the project'"),
)
JUDGED = """judged AS (SELECT 'replies-' || doc_id % 2 AS file, quality, toxic, doc_id AS pair_id, 1 + quality * 3 + toxic AS score,
  last_value(CASE WHEN doc_id % 5 = 0 THEN 'judge ' || doc_id % 3 END IGNORE NULLS) OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) AS judge
  FROM labels), kept AS (SELECT * FROM judged WHERE NOT (quality = 0 AND toxic = 1))"""
ORACLES["parse_judgements"] = f"WITH {JUDGED} SELECT file, judge, pair_id, score, 'because :: so' AS reason FROM kept"
ORACLES["judge_scores"] = f"""WITH {JUDGED}, {NUMBERED} SELECT judge, "group", count(*) AS n_scores, round(avg(score), 6) AS mean_score
FROM kept JOIN numbered USING (pair_id) GROUP BY ALL"""

# ------------------------------------------------------------------ telemetry

LOG = """log AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'INFO' AS level, 'Svc.' || event_type AS service,
  'Step ' || user_id % 3 || CASE WHEN user_id % 3 = 1 THEN chr(30) || chr(31) ELSE '' END AS operation, CAST(floor(value * 100) AS BIGINT) AS duration_ms FROM events WHERE event_type <> 'error')"""
_STATS = """count(*) AS n, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(avg(duration_ms), 6) AS avg_ms,
  round(median(duration_ms), 6) AS median_ms, round(coalesce(stddev_samp(duration_ms), 0), 6) AS stdev_ms"""
ORACLES["log_parse"] = f"WITH {LOG} SELECT * FROM log"
ORACLES["latency_stats"] = f"WITH {LOG} SELECT service || ':' || operation AS operation_key, {_STATS} FROM log GROUP BY 1"
ORACLES["task_durations"] = f"""SELECT event_type || ':g' || user_id % 3 AS operation_key, {_STATS}
FROM (SELECT *, CAST(floor(value * 1000) AS BIGINT) AS duration_ms FROM events) GROUP BY 1"""
