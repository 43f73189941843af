"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from rugosa.llm.url_filter import DAMPING, THRESHOLD, TOLERANCE


def url_filter_sql() -> str:
    import math

    steps = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
    return rf"""
WITH RECURSIVE rest AS (
  SELECT page_id, html, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS r FROM pages
), parsed AS (
  SELECT page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed
), judged AS (
  SELECT *, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
                      WHEN 'org/fr/' THEN 'allow' WHEN 'example.net/en/' THEN 'allow' END AS rv FROM ruled
), links AS (
  SELECT host AS src, unnest(list_distinct(list_transform(
    list_concat(regexp_extract_all(html, '(?:href|src|HREF|SRC)\s*=\s*["'']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1),
                regexp_extract_all(html, '[A-Za-z0-9._-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1)),
    lambda x: lower(regexp_replace(x, '^[^@]*@|:[0-9]*$', '', 'g'))))) AS dst
  FROM judged WHERE host <> '' AND html IS NOT NULL
), edges AS (
  SELECT src, dst, count(*) AS n FROM links WHERE dst <> '' AND src <> dst GROUP BY 1, 2
), both_ways AS (
  SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges
), moves AS (
  SELECT kind, src, dst, {DAMPING} * n / sum(n) OVER (PARTITION BY kind, src) AS w FROM both_ways
), seeds AS (
  SELECT host, avg(CASE WHEN rv = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN rv = 'block' THEN 1.0 ELSE 0.0 END) AS d
  FROM judged WHERE host <> '' GROUP BY 1
), wave AS (
  SELECT 0 AS k, 'trust' AS kind, host, t AS mass FROM seeds WHERE t > 0
  UNION ALL SELECT 0, 'distrust', host, d FROM seeds WHERE d > 0
  UNION ALL
  SELECT k + 1, moves.kind, dst, sum(mass * w) FROM wave JOIN moves ON wave.kind = moves.kind AND wave.host = moves.src
  WHERE k < {steps} GROUP BY ALL
), scores AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END) AS trust,
         sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END) AS distrust FROM wave GROUP BY 1
)
SELECT page_id, host, path, rule,
       coalesce(rv, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores USING (host)
"""
