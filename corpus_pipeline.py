"""A training corpus from documents: five stages, each over all that its predecessor kept.

Every stage but the last returns the columns of documents; the last adds how often the mix takes a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm.common import materialise, sized, table
from serieslab.llm.contamination import decontaminated
from serieslab.llm.jaccard import one_of_each_class
from serieslab.llm.mixing import copies_of
from serieslab.llm.quality import base_failed, first_rule, learn_rules, text_statistics
from serieslab.llm.secrets import redact_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The rules are learned from the labelled documents among them."""
    labels = table(spark, sf_dir, "labels")
    ids = sized(materialise(labels.select("doc_id").where("doc_id is not null").distinct()))
    rules = learn_rules(materialise(text_statistics(docs.join(ids, "doc_id", "left_semi"))), labels)
    stats = text_statistics(docs.withColumn("_sl_row", F.struct(*docs.columns)), ("_sl_row",))
    counted = stats.observe("quality rules", F.count(F.lit(1)).alias("judged"))  # and keeps the filter from being pushed into the statistics
    return counted.where(~base_failed() & first_rule(rules).isNull()).select("_sl_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: a row of the least doc_id. Repeated and null keys are told apart by their texts; of rows
    with equal key and text one stays."""
    return one_of_each_class(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is close to a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets replaced by a mark, and n_chars counted again."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size in words, their source's target, the number of copies and the words that these have.
    Columns of these names are replaced. Rows that are equal in all columns become one, whose copies count for all of them."""
    numbers = ["size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c not in numbers]
    h = F.xxhash64(*docs.columns)
    found = copies_of(docs, h=h).where("copies > 0").withColumn("taken", F.col("copies") * F.col("size"))
    found = materialise(found.select(F.col("h").alias("_sl_h"), F.col("doc_id").alias("_sl_id"), F.col("times").alias("_sl_times"), F.struct(*numbers).alias("_sl_numbers")))
    keyed = docs.withColumn("_sl_own", h)
    met = (F.col("_sl_own") == F.col("_sl_h")) & F.col("doc_id").eqNullSafe(F.col("_sl_id"))
    single = keyed.join(sized(found.where("_sl_times = 1")), met).select(*own, "_sl_numbers.*")
    several = keyed.join(sized(found.where("_sl_times > 1")), met)
    one = several.groupBy("_sl_h", "_sl_id").agg(F.first(F.struct(*own, "_sl_numbers")).alias("_sl_row")).select("_sl_row.*").select(*own, "_sl_numbers.*")
    return single.unionByName(one)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", without_secrets),
    ("mixing to target weights", mixed),
]

#: Stages learn, sample hashes and iterate, which SQL cannot express; tests compare the result with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
