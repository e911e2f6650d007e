"""Joins, sets and choices among rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslab.core import matched, with_scalars


def attach_features(df: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    return df.join(features, on, "left")


def attach_by_position(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both with the same series and idx."""
    return matched(df, other, ["series", "idx"])


def reindex_to(df: DataFrame, base: DataFrame) -> DataFrame:
    """All rows of base, with the other's values where it has the row."""
    return matched(base.select("series", "idx"), df, ["series", "idx"], "left")


def broadcast_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Adds one row's values for each series to all its rows; Spark picks the join by the table's size."""
    return with_scalars(df, scalars, "left")


def feature_pairs(features: DataFrame, block: int = 1000) -> DataFrame:
    """(a, b), a < b, of a list of names; a repeated name pairs as often as it comes, a null one not at all.

    Names are dealt to blocks of about `block` by their hash. Each goes once to every block, so that a task joins two blocks on their numbers
    and the names that are moved are a `block`th of the pairs."""
    blocks = max(1, -(-features.count() // block))
    own, others = F.pmod(F.xxhash64("feature"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = features.select(F.col("feature").alias("a"), own.alias("i"), others.alias("j"))
    b = features.select(F.col("feature").alias("b"), own.alias("j"), others.alias("i"))
    return a.join(b, ["i", "j"]).where("a < b").select("a", "b")


def union_parts(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def new_names(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.select("name").exceptAll(before.select("name"))


def feature_overlap(features: DataFrame) -> DataFrame:
    """(feature, models, in_all) of (model_id, feature)."""
    n = features.agg(F.count_distinct("model_id").alias("_n"))
    each = features.groupBy("feature").agg(F.count_distinct("model_id").alias("models"))
    return each.join(F.broadcast(n)).select("feature", "models", (F.col("models") == F.col("_n")).alias("in_all"))  # one row


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def top_k_per_group(df: DataFrame, by: str, score: str, k: int, tie: str, name: str = "place") -> DataFrame:
    """Spark cuts each task's groups to k rows before they are dealt by group."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def pick_best_per_category(df: DataFrame, category: str, name: str, score: str) -> DataFrame:
    """The best-scored name of each category, else its first."""
    return df.groupBy(category).agg(F.min_by(name, F.struct(-F.coalesce(score, F.lit(-1e300)), name)).alias("best"))


def skip_done(pending: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return pending.join(done.select(key), key, "left_anti")
