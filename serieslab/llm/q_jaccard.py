"""Query op3_jaccard: class and links of every row of documents. The candidate search is probabilistic, so there is no SQL; tests
compare it with all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieslab.llm.common import table
from serieslab.llm.jaccard import similarity_classes


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard": op3_jaccard}
ORACLE_SQL: dict[str, str] = {}
