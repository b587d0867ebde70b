"""DuckDB SQL for the operators that SQL can express, over the same tables."""

OP2 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM docs),
wins AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs)),
firsts AS (SELECT h, min(doc_id) AS least FROM wins GROUP BY h),
hit AS (SELECT doc_id, i FROM wins JOIN firsts USING (h) WHERE least < doc_id),
gone AS (SELECT words.doc_id, j, word, max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cut FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.i = j),
left_ AS (SELECT doc_id, count(*) AS n_words, CAST(sum(cut) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (cut = 0) AS kept FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN left_ USING (doc_id)"""

OP6 = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST, length(rule_host) DESC, rule_verdict DESC) AS k
 FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM r WHERE k = 1"""

OP7 = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, k, n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM o),
w AS (SELECT min(conv_id) AS conv_id FROM p WHERE k = n GROUP BY so_far HAVING so_far NOT IN (SELECT so_far FROM p WHERE k < n))
SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || regexp_replace(role, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || chr(10) || regexp_replace(text, '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM o JOIN w USING (conv_id) GROUP BY conv_id"""

ORACLES = {"op2_substrings": OP2, "op6_url_filter": OP6, "op7_chat_format": OP7}
