"""DuckDB SQL of the training-data queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op10_threshold_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

# Conversations of sequences (c, l): a turn is its md5 and its code points; crc32 by its definition, a bit at a time.
SQL["op11_rollup_trie"] = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), id) AS p, id, n
  FROM (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n,
               md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id
        FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT c, list(id ORDER BY p) AS ids, list(n ORDER BY p) AS ns FROM t GROUP BY c),
cut AS (
  SELECT c, ids, ns, c - c % 100 AS b, xor(list_reduce(
    [ord(x) FOR x IN string_split(CAST(c AS VARCHAR), '')],
    lambda acc, byte: list_reduce([1, 2, 3, 4, 5, 6, 7, 8],
      lambda r, i: xor(r >> 1, (r & 1) * CAST(3988292384 AS BIGINT)), xor(acc, CAST(byte AS BIGINT))),
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 6 AS h FROM own),
seq AS (
  SELECT cut.c, list_concat(coalesce(o.ids[1:h], []), cut.ids[h + 1:]) AS ids,
         list_concat(coalesce(o.ns[1:h], []), cut.ns[h + 1:]) AS ns
  FROM cut LEFT JOIN own o ON o.c = cut.b),
member AS (
  SELECT c, d, md5(array_to_string(ids[1:d], ',')) AS k, md5(array_to_string(ids[1:d - 1], ',')) AS up,
         CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(ids) AS ends
  FROM (SELECT c, ids, ns, unnest(range(0, len(ids) + 1)) AS d FROM seq)),
node AS (
  SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, any_value(n) AS n,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM member GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
sums AS (
  SELECT a.d, a.k, sum(CASE WHEN kids.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves,
         sum((node.n_convs - 1) * node.n) AS saved
  FROM node JOIN member a ON a.c = node.c AND a.d <= node.d
  LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k GROUP BY a.d, a.k)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, p.c AS parent_conv_id, node.n_convs,
       CAST(coalesce(kids.n_children, 0) AS BIGINT) AS n_children, CAST(sums.n_leaves AS BIGINT) AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN sums ON sums.d = node.d AND sums.k = node.k
LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k
LEFT JOIN node p ON node.d > 0 AND p.d = node.d - 1 AND p.k = node.up
"""


def _kmeans_sql(k: int, rounds: int) -> str:
    """A pair of steps for every round: nearest centroid of every vector, then the floor of the means."""
    nearest = """
n{i} AS MATERIALIZED (
  SELECT row_id, vec_id, v, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
    SELECT x.row_id, x.vec_id, x.v, m.c, CAST(x.sq + m.sq - 2 * list_inner_product(x.v, m.v) AS BIGINT) AS dist
    FROM x, (SELECT c, v, list_inner_product(v, v) AS sq FROM c{i}) m)
  GROUP BY row_id, vec_id, v)"""
    moved = """,
c{j} AS MATERIALIZED (
  SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM n{i})
  UNION ALL
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY d) AS v FROM (
    SELECT c, d, sum(CAST(v[d] AS BIGINT)) AS s, count(*) AS n FROM n{i}, (SELECT unnest(range(1, 65)) AS d) GROUP BY c, d)
  GROUP BY c),"""
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, v, list_inner_product(v, v) AS sq FROM (
    SELECT vec_id, [floor(1024 * CAST(e AS DOUBLE)) FOR e IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64
      AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (
    SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM x ORDER BY h LIMIT {k})),""" + "".join(
        nearest.format(i=i) + moved.format(i=i, j=i + 1) for i in range(rounds)) + nearest.format(i=rounds) + f"""
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, dist AS distance,
       CAST(sum(dist) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([CAST(CAST(e AS BIGINT) AS VARCHAR) FOR e IN m.v], ',')) AS centroid_sha256
FROM n{rounds} n JOIN c{rounds} m ON m.c = n.c
"""


SQL["op12_mean_order_clusters"] = _kmeans_sql(8, 10)

SQL["op13_indexed_warc"] = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM min(page_id) OVER (PARTITION BY payload_digest)
                 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS refers_to FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url
FROM f
"""
