"""DuckDB SQL of the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

from shapecode.llm import sharding

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

REPEATED_WINDOWS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
wins AS (SELECT doc_id, a, md5(array_to_string(ws[a:a + 19], ' ')) AS h FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS a FROM d WHERE len(ws) >= 20)),
later AS (SELECT doc_id, a FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, a) AS rn FROM wins) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, a + j AS p FROM later, (SELECT unnest(range(0, 20)) AS j)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""

NGRAM_LINKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5
  THEN list_transform(range(1, len(ws) - 3), lambda a: array_to_string(ws[a:a + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS same FROM g GROUP BY 1),
l AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE p.shared >= 0.8 * (na.n + nb.n - p.shared) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS group_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
cl AS (SELECT same, min(doc_id) AS class_id FROM n GROUP BY 1)
SELECT d.doc_id, coalesce(cl.class_id, d.doc_id) AS class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.group_id,
  d.doc_id = c.group_id AS kept
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN cl ON cl.same = n.same LEFT JOIN k ON k.a = d.doc_id"""

WARC_ROUND_TRIP = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM q"""


def _feistel(source: str, rounds: int, seed: int) -> str:
    """One application of the network to ``x`` of ``source(row_number, x, k, a, b, n)``: columns l, r."""
    q = f"SELECT *, x % a AS l, x // a AS r FROM ({source})"
    for j in range(1, rounds + 1):
        v = f"CAST('0x' || substr(md5('{seed}:{j}:' || CAST(r AS VARCHAR)), 1, 13) AS BIGINT)"
        q = f"SELECT * REPLACE (r AS l, (l + {v}) % {'a' if j % 2 else 'b'} AS r) FROM ({q})"
    return q


def feistel_shards(shards: int, rounds: int = sharding.ROUNDS, seed: int = sharding.SEED, overhead: int = sharding.OVERHEAD) -> str:
    """Row numbers, their permutation and the checksums, from their definitions (CRC-32 byte by byte)."""
    return f"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(
    list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END) AS v FROM range(256) u(n))),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS nb FROM documents),
crc AS (SELECT doc_id, nb, xor(list_reduce(list_prepend(CAST({2**32 - 1} AS BIGINT),
    list_transform(range(nb), lambda i: CAST('0x' || hx[2 * i + 1 : 2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), {2**32 - 1}) AS text_crc32 FROM d, t),
numbered AS (SELECT doc_id, CAST(nb + {overhead} AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, nb) - 1 AS row_number FROM crc),
g AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, CASE WHEN n > 1
    THEN CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 ELSE 1 END AS a FROM (SELECT count(*) AS n FROM numbered))),
f AS (SELECT row_number, row_number AS x, 0 AS k, a, b, n FROM numbered, g
    UNION ALL SELECT row_number, {'l * a + r' if rounds % 2 else 'l + r * a'} AS x, k + 1 AS k, a, b, n
    FROM ({_feistel("SELECT * FROM f WHERE k = 0 OR x >= n", rounds, seed)})),
p AS (SELECT row_number, x FROM f WHERE k > 0 AND x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot,
    CAST(NULL AS INTEGER) AS grown_shard, CAST(numbered.row_number AS BIGINT) AS row_number
FROM numbered JOIN p ON p.row_number = numbered.row_number"""


_ENDS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SHARED_LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d),
k AS (SELECT *, translate(trim(line, {_ENDS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.r, k.p, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT d.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d ON d.r = m.r GROUP BY d.r, d.doc_id"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
  CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score,
  row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS rn FROM s WHERE same) WHERE rn <= 5)
SELECT * FROM (SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score) WHERE rank <= 5"""

PREFIX_TRIE = f"""
WITH tab AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(
    list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END) AS v FROM range(256) u(n))),
t0 AS (SELECT conv_id AS c, turn, octet_length(encode(coalesce(text, ''))) AS b,
  md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, g, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS i FROM t0),
v AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(CAST({2**32 - 1} AS BIGINT),
    list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), {2**32 - 1}) % 9 AS h FROM (SELECT DISTINCT c FROM t), tab),
m AS (SELECT v.c, v.base, v.h, count(t.i) AS m FROM v LEFT JOIN t ON t.c = v.base AND t.i <= v.h GROUP BY 1, 2, 3),
r AS (SELECT m.c, t.i AS d, t.g, t.b FROM m JOIN t ON t.c = m.base AND t.i <= m.h
  UNION ALL SELECT m.c, m.m + t.i - m.h, t.g, t.b FROM m JOIN t ON t.c = m.c AND t.i > m.h),
p AS (SELECT c, d, b, string_agg(g, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM r
  UNION ALL SELECT c, 0, 0, '' FROM v),
q AS (SELECT *, max(d) OVER (PARTITION BY c) AS n FROM p),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b, max(n) = d AS leaf,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM q GROUP BY 1, 2),
a AS (SELECT n.*, left(p, 32 * CAST(k AS BIGINT)) AS up, k FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM n) n),
s AS (SELECT up AS p, k AS d, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (d = k + 1) AS n_children, sum((n_convs - 1) * b) AS saved FROM a GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.p = n.p AND s.d = n.d LEFT JOIN n u ON u.d = n.d - 1 AND u.p = left(n.p, 32 * (CAST(n.d AS BIGINT) - 1)) AND n.d > 0"""
