"""SQL of the centroid clustering: the same rounds with every distance computed."""

from __future__ import annotations


def centroid_clustering_sql(size: int = 64, count: int = 40, rounds: int = 5, seed: int = 2) -> str:
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings
  WHERE len(embedding) = {size} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(CAST(e AS DOUBLE))]) = {size})""",
        "cells AS MATERIALIZED (SELECT r, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM kept)",
        f"""drawn AS MATERIALIZED (
  SELECT r, row_number() OVER (ORDER BY draw, x) - 1 AS num
  FROM (SELECT r, x, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS draw FROM kept) ORDER BY draw, x LIMIT {count})""",
        "c0 AS MATERIALIZED (SELECT num, dim, CAST(v AS HUGEINT) AS v FROM drawn JOIN cells USING (r))",
    ]
    for k in range(rounds + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(num, d * {count} + num) AS num, min(d) AS d
  FROM (SELECT cells.r, c.num, sum((cells.v - c.v) * (cells.v - c.v)) AS d FROM cells JOIN c{k} c USING (dim) GROUP BY cells.r, c.num) GROUP BY r)"""
        )
        if k < rounds:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT c.num, c.dim, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT num, dim, (s - ((s % n) + n) % n) // n AS v
    FROM (SELECT num, dim, sum(cells.v) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{k} JOIN cells USING (r) GROUP BY num, dim)) m
  ON c.num = m.num AND c.dim = m.dim)"""
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT kept.vec_id, CAST(a.num AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.num) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM kept JOIN a{rounds} a USING (r)
JOIN (SELECT num, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY num) h ON h.num = a.num"""
