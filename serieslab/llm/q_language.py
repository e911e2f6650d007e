"""Query op4_language: the predicted language of every whole text of documents. Tests measure held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm.common import table
from serieslab.llm.language import classify, held_out, learn_dictionaries


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5)
    dictionaries = learn_dictionaries(docs.where(~out))
    return classify(docs, dictionaries).select("doc_id", out.alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op4_language": op4_language}
ORACLE_SQL: dict[str, str] = {}
