"""Query op9_urls: the verdict on every url of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieslab.llm.common import table
from serieslab.llm.urls import LOWER, UPPER, UrlRule, judge_urls

#: The rules of the query.
RULES = [
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "url")


_VALUES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
_SQL = f"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES {_VALUES}),
f AS (SELECT h.page_id, h.url, h.host, h.path, max_by({{'n': rhost || rpath, 'v': verdict}}, length(rhost || rpath)) AS b
  FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, b.n AS rule, coalesce(b.v, 'allow') AS verdict, url FROM f"""

QUERIES = {"op9_urls": op9_urls}
ORACLE_SQL = {"op9_urls": _SQL}
