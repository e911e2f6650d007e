"""Query op5_mixing: what a mix of all documents by source takes of each. Newton's iterations have no SQL; tests check the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieslab.llm.common import table
from serieslab.llm.mixing import mix


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL: dict[str, str] = {}
