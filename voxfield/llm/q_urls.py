"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxfield.llm.registry import query, table
from voxfield.llm.urls import judge_urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Links of the pages as the operator reads them, for targets with a scheme.
SQL = r"""
WITH RECURSIVE rules(what, rule) AS (
    VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')
), tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL
), targets AS (
    SELECT url, trim(CASE
        WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^\s"''>]*)', 1)
        WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is);\s*url\s*=\s*["'']?([^"''>]+)', 1)
        ELSE '' END) AS target
    FROM tags
), urls AS (
    SELECT url FROM pages UNION SELECT target FROM targets
), parsed AS (
    SELECT url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1) AS tail
    FROM (SELECT url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM urls)
), judged AS (
    SELECT p.url, any_value(p.host) AS host, any_value(p.path) AS path, any_value(CASE WHEN p.host <> '' THEN p.host || p.tail END) AS key,
        arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.what, length(r.rule)) AS what
    FROM parsed p LEFT JOIN rules r
      ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
     AND starts_with(p.path, substr(r.rule, position('/' IN r.rule)))
    GROUP BY p.url
), edges AS (
    SELECT DISTINCT a.key AS a, b.key AS b FROM targets t JOIN judged a ON a.url = t.url JOIN judged b ON b.url = t.target WHERE t.target <> ''
), reach(a, b) AS (
    SELECT a, b FROM (SELECT a, b FROM edges UNION SELECT b, a FROM edges)
    UNION
    SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON r.b = e.a
), brought AS (
    SELECT DISTINCT r.a AS key FROM reach r JOIN judged j ON j.key = r.b WHERE j.what = 'block'
), alias AS (
    SELECT a AS key, least(a, min(b)) AS alias FROM reach WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY a
)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule,
    coalesce(j.what, CASE WHEN b.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict, a.alias
FROM pages p LEFT JOIN judged j ON p.url = j.url LEFT JOIN brought b ON b.key = j.key LEFT JOIN alias a ON a.key = j.key
"""


@query("op1_url_filter", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
