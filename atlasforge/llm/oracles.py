"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

SQL = {
    "op8_urlfilter": r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, rest,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)=')) AS kept
  FROM cut
), canon AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS c
  FROM parts
), known AS (
  SELECT h || '.example.' || d || '/' || l || '/' || k AS c
  FROM range(4000) n(k), (VALUES ('ads-track'), ('spam-farm'), ('casino-win'), ('adult-x'), ('cheap-pills'), ('free-bets')) hosts(h), (VALUES ('com'), ('net'), ('org')) tops(d), (VALUES ('en'), ('de'), ('fr'), ('es')) langs(l)
), rules(says, rule, h, p) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM canon JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT canon.page_id, canon.host, canon.path, fit.rule, coalesce(fit.says, CASE WHEN known.c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, known.c IS NOT NULL AS listed
FROM canon LEFT JOIN fit USING (page_id) LEFT JOIN known ON canon.c = known.c
""",
}
