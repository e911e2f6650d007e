"""Query op2_quality: statistics and verdict for every whole text of documents. The verdict is learned, so there is no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieslab.llm.common import materialise, table
from serieslab.llm.quality import judged, learn_rules, text_statistics


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(text_statistics(table(spark, sf_dir, "documents")))
    rules = learn_rules(stats, table(spark, sf_dir, "labels"))
    return judged(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
