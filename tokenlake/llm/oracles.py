"""DuckDB SQL for the queries that SQL can express."""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, doc_id, i, array_to_string(ws[i : i + 19], ' ') AS s
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
late AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(struct_pack(a := doc_id, b := i)) OVER (PARTITION BY s) AS f FROM win)
  WHERE struct_pack(a := doc_id, b := i) > f),
hit AS (SELECT DISTINCT r, i + k AS p FROM late, range(0, 20) t(k)),
word AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT word.r, string_agg(x, ' ' ORDER BY word.p) AS s, count(*) AS n
  FROM word LEFT JOIN hit ON hit.r = word.r AND hit.p = word.p WHERE hit.r IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.r = w.r
"""

OP10 = r"""
WITH RECURSIVE lowered AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i : i + 12], ' ') AS s
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS s FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(hit.n > 0 AND 20 * hit.n >= len(ws), false) AS contaminated
FROM w LEFT JOIN hit ON hit.r = w.r LEFT JOIN items ON items.r = w.r
"""

OP1 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT r, h || q AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC, length(h) DESC, v DESC) AS k
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON m.r = p.r AND k = 1
"""

OP4 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d
"""

ORACLES: dict[str, str] = {
    "op1_url_filters": OP1,
    "op4_warc": OP4,
    "op9_substring_dedup": OP9,
    "op10_benchmark_decontamination": OP10,
}
