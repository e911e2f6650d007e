"""Query op8_html: the main text of every page. Tests compare it with pages whose text is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieslab.llm.common import table
from serieslab.llm.html_text import extract_text


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html": op8_html}
ORACLE_SQL: dict[str, str] = {}
