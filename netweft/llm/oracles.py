"""DuckDB's SQL for the queries of this subpackage that SQL can express."""
from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op1_minhash": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON r.other = w.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON least.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
""",
    "op4_warc": """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
digests AS (SELECT *, sha1(p) AS h FROM payloads),
fives AS (SELECT *, list_transform(range(0, 160, 5), lambda k: list_sum(list_transform(range(5), lambda j:
  ((instr('0123456789abcdef', h[(k + j) // 4 + 1]) - 1) >> (3 - (k + j) % 4) & 1) << (4 - j)))::INT) AS v FROM digests)
SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[x + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM fives
""",
}
