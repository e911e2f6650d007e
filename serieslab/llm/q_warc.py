"""Query op12_warc: pages through WARC archives and back, every payload held once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm.common import table
from serieslab.llm.warc import BASE32, DIGITS, archived_pages

#: Fixed value: the least bytes of a payload that others may refer to.
LEAST = 0


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived_pages(table(spark, sf_dir, "pages"), LEAST)
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("original_key").cast("long").alias("refers_to"))


_FIVES = " || ".join(f"to_base(('0x' || substr(h, {1 + 10 * i}, 10))::BIGINT, 32, 8)" for i in range(4))
_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT page_id, payload_bytes, translate({_FIVES}, '{DIGITS}', '{BASE32}') AS payload_digest,
  row_number() OVER w AS k, max(page_id) OVER (PARTITION BY h) AS held FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k > 1 AND payload_bytes >= {LEAST} THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k > 1 AND payload_bytes >= {LEAST} THEN held END AS refers_to FROM r"""

QUERIES = {"op12_warc": op12_warc}
ORACLE_SQL = {"op12_warc": _SQL}
