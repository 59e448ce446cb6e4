"""DuckDB SQL for vector codes and the prefix trie, put together from their repeated parts."""

from __future__ import annotations


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Full scans in every round: ``d * 65536 + e`` is least for the nearest entry, the lowest of equals."""
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x,
         row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e
  FROM kept, unnest(range({parts})) AS t(p)),
book0 AS MATERIALIZED (SELECT p, e, x FROM points WHERE e < {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT vec_id, a.p, any_value(a.x) AS x,
         min((list_dot_product(a.x::DOUBLE[], a.x::DOUBLE[]) - 2 * list_dot_product(a.x::DOUBLE[], b.x::DOUBLE[])
              + list_dot_product(b.x::DOUBLE[], b.x::DOUBLE[]))::BIGINT * 65536 + b.e) AS best
  FROM points a JOIN book{n} b ON a.p = b.p GROUP BY vec_id, a.p)""")
        if n < rounds:
            steps.append(f"""book{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN (
    SELECT p, e, list(s ORDER BY i) AS x FROM (
      SELECT p, best % 65536 AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s
      FROM near{n}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL)
    GROUP BY p, e) m USING (p, e))""")
    return ",\n".join(steps) + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', best % 65536), '' ORDER BY p) AS code, sum(best // 65536)::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
whole AS (
  SELECT a.c, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) AS seq FROM turns a LEFT JOIN turns b ON b.c = a.c - a.c % 100),
members AS (SELECT c, d, seq[1:d] AS k, len(seq) = d AS ends FROM whole, unnest(range(0, len(seq) + 1)) AS t(d)),
nodes AS MATERIALIZED (
  SELECT d, k, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(k[d].t) END AS saved
  FROM members GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
sums AS (SELECT a AS d, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM full_nodes, unnest(range(0, d + 1)) AS t(a) GROUP BY ALL)
SELECT v.c AS conv_id, v.d AS depth, up.c AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM full_nodes v JOIN sums USING (d, k) LEFT JOIN nodes up ON up.d = v.d - 1 AND up.k = v.k[1:v.d - 1]"""
