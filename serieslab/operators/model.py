"""Training, evaluating and storing the final tree ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.core import lengths, with_row_index, with_scalars
from serieslab.operators.boosting import Ensemble, boost, predicted
from serieslab.operators.labels import task_type
from serieslab.operators.metrics import auc_roc, classification_metrics, skill_scores, spearman_ic


def train_final(df: DataFrame, y: str, columns: list[str], test: float = 0.2, task: str = "regression", least: int = 100, **fit) -> tuple[Ensemble, DataFrame]:
    """(model, rows with split and prediction): complete rows, split by time, an ensemble on the first part. The last tenth of that part stops
    the boosting early. The task "auto" follows from the target's values."""
    complete = with_row_index(df.dropna(subset=[*columns, y]), ["series"], ["idx"], "_place")
    head = F.floor(F.col("_n") * (1 - test))
    rows = with_scalars(complete, lengths(complete).withColumnRenamed("n", "_n")).withColumn("split", F.when(F.col("_place") < head, "train").otherwise("test"))
    if rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} complete rows")
    if task == "auto":
        task = task_type(rows.select(F.lit("all").alias("series"), y), y).first()["task"]
    early = (F.col("split") == "train") & (F.col("_place") < F.floor(head * 0.9))
    (model,) = boost(rows, y, columns, task, [(early, (F.col("split") == "train") & ~early)], **fit)
    return model, predicted(rows, model).select("series", "idx", F.col(y).cast("double").alias("y"), "split", "prediction")


def evaluate(said: DataFrame, task: str = "regression") -> DataFrame:
    """A row for each split. For numbers n, mse, mae, r2, skill_zero and ic (rank correlation over the split's rows); for classes n, accuracy,
    precision, recall, f1, and auc of two classes from 0 and 1 (else null). In both cases means and standard deviations of prediction and target, and primary: F1, or
    the skill against zero, else the size of ic, else r2. Rows with a null on either side are left out."""
    rows = said.where(F.col("y").isNotNull() & F.col("prediction").isNotNull())
    facts = rows.groupBy("split").agg(
        F.count("*").alias("n"), F.avg("prediction").alias("pred_mean"), F.stddev_pop("prediction").alias("pred_std"), F.avg("y").alias("target_mean"), F.stddev_pop("y").alias("target_std"),
        F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"), F.bool_and(F.col("y").isin(0.0, 1.0)).alias("_binary"),
    )
    spread = ["pred_mean", "pred_std", "target_mean", "target_std"]
    if task != "regression":
        parts = [r["split"] for r in facts.select("split").collect()]
        each = [classification_metrics(rows.where(F.col("split").eqNullSafe(F.lit(p))), "y", "prediction").drop("n").withColumn("split", F.lit(p).cast("string")) for p in parts]
        if not each:
            return facts.select("split", "n", *[F.lit(None).cast("double").alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")], *spread, F.lit(None).cast("double").alias("primary"))
        scores = each[0]
        for e in each[1:]:
            scores = scores.unionByName(e)
        auc = auc_roc(rows.withColumn("series", F.col("split")), "y", "prediction").withColumnRenamed("series", "split")
        out = with_scalars(facts, scores, "left", "split").transform(with_scalars, auc, "left", "split")
        return out.select("split", "n", "accuracy", "precision", "recall", "f1", F.when(F.col("_binary"), F.col("auc")).alias("auc"), *spread, F.col("f1").alias("primary"))
    m = skill_scores(rows, "y", "prediction", "split").select("split", "mse", F.col("skill_mean").alias("r2"), "skill_zero")
    ic = spearman_ic(rows.withColumn("series", F.col("split")), "y", "prediction").withColumnRenamed("series", "split")
    out = with_scalars(facts, m, "left", "split").transform(with_scalars, ic, "left", "split")
    return out.select("split", "n", "mse", "mae", "r2", "skill_zero", "ic", *spread, F.coalesce("skill_zero", F.abs("ic"), "r2").alias("primary"))


def save_model(spark: SparkSession, model: Ensemble, path: str, meta: DataFrame) -> None:
    """The fitted model and a table of facts about it, under one path."""
    spark.createDataFrame([(model.to_json(),)], "model string").write.mode("overwrite").parquet(f"{path}/model")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[Ensemble, DataFrame]:
    """(model, its table of facts) as saved under a path."""
    return Ensemble.from_json(spark.read.parquet(f"{path}/model").first()["model"]), spark.read.parquet(f"{path}/meta")
