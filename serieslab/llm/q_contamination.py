"""Query op10_contamination: windows of documents that are close to benchmark items. Tests compare it with all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieslab.llm.common import table
from serieslab.llm.contamination import contaminated_windows


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_contamination": op10_contamination}
ORACLE_SQL: dict[str, str] = {}
