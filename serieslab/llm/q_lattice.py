"""Query op7_lattice: scores of every whole text of documents. Tests compare base_score with counts and score with all segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm.common import table
from serieslab.llm.language import held_out
from serieslab.llm.lattice import Pieces, score_texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op7_lattice(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10), Pieces.load(vocabulary))


QUERIES = {"op7_lattice": op7_lattice}
ORACLE_SQL: dict[str, str] = {}
