"""DuckDB SQL for the queries that SQL can express."""

_SOURCES = """
sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM {docs}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sources),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS stop,
    (sum(source_size::DOUBLE) OVER () - 3.0::DOUBLE * coalesce(sum(source_size::DOUBLE) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(w * coalesce((SELECT level FROM levels WHERE level <= stop ORDER BY stop, level LIMIT 1), 0.0::DOUBLE), 3.0::DOUBLE * source_size) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS n FROM placed)
"""
_MIX = "SELECT doc_id, size, source_size, target, CAST(n * size + greatest(0, least(budget - n * source_size - before, size)) AS BIGINT) AS taken FROM passes"

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
m AS (SELECT *, len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(role, '<\\*\|')) AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + marks) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id""",
    "op10_mixing": "WITH" + _SOURCES.format(docs="documents") + _MIX,
    "op11_ranked_lexical_search": f"""
WITH i AS (SELECT DISTINCT item_id, {_TERMS} AS t FROM benchmark WHERE item_id IS NOT NULL),
d0 AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, {_TERMS} AS t FROM d0),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM d GROUP BY r, t),
n AS (SELECT r, any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY r),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, g GROUP BY t, docs),
s AS (
  SELECT i.item_id, n.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM i JOIN tf USING (t) JOIN w USING (t) JOIN n USING (r), g GROUP BY i.item_id, r, n.doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    # the articles of the given pages, which all mark them and use no other references than these
    "op12_html_extraction": r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS blocks FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(blocks, lambda x:
  trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM a)
SELECT page_id, url, coalesce(array_to_string(lines, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(lines, chr(10)), '')) AS BIGINT) AS n_chars FROM b""",
}
