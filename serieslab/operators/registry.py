"""Model registry and run log as tables: models (model_id, symbol, timeframe, version, score, created), features (model_id, feature,
importance, rank), metrics (model_id, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.core import finite


def register_model(models: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All models, the new ones numbered on within their keys; the highest version of each is active."""
    top = models.groupBy(*keys).agg(F.max("version").alias("_top"))
    own = Window.partitionBy(*keys).orderBy("model_id")
    added = new.withColumn("_r", F.row_number().over(own)).join(top, keys, "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + F.col("_r")).cast("int")).drop("_r", "_top")
    every = models.unionByName(added, allowMissingColumns=True)
    newest = every.groupBy(*keys).agg(F.max("version").alias("_newest"))
    return every.join(newest, keys).withColumn("is_active", F.col("version") == F.col("_newest")).drop("_newest")


def metric_category(name: str) -> Column:
    c = F.col(name)
    return F.when(c.startswith("train_"), "training").when(c.startswith("test_"), "test").when(c.rlike("r2|mse|mae|rmse"), "regression").otherwise("other")


def list_models(models: DataFrame, active: bool | None = True, symbol: str | None = None) -> DataFrame:
    rows = models if active is None else models.where(F.col("is_active") == active)
    rows = rows if symbol is None else rows.where(F.col("symbol") == symbol)
    return rows.orderBy("symbol", "timeframe", F.desc("version"), "model_id")


def model_details(models: DataFrame, features: DataFrame, metrics: DataFrame, model_id: int) -> DataFrame:
    """One row: the model, its features by rank and its metrics by name, as text."""
    f = features.where(F.col("model_id") == model_id).groupBy("model_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",").alias("features"))
    m = metrics.where(F.col("model_id") == model_id).groupBy("model_id").agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("metrics"))
    return models.where(F.col("model_id") == model_id).join(f, "model_id", "left").join(m, "model_id", "left")


def compare_models(models: DataFrame, features: DataFrame, metrics: DataFrame, wanted: list[str], k: int = 10) -> DataFrame:
    """For each model its k first features and the wanted metrics as columns."""
    top = features.where(F.col("rank") <= k).groupBy("model_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",").alias("top_features"))
    wide = metrics.groupBy("model_id").pivot("metric", wanted).agg(F.max("value"))
    return models.join(top, "model_id", "left").join(wide, "model_id", "left")


def performance_summary(models: DataFrame, features: DataFrame, metrics: DataFrame, wanted: list[str], k: int = 10) -> DataFrame:
    """compare_models with the number of features."""
    n = features.groupBy("model_id").agg(F.count("*").alias("n_features"))
    return compare_models(models, features, metrics, wanted, k).join(n, "model_id", "left")


def rank_models(metrics: DataFrame, models: DataFrame, metric: str) -> DataFrame:
    """(model_id, symbol, value, place) within each symbol, by one metric, descending; equal values share a place."""
    rows = metrics.where(F.col("metric") == metric).join(models.select("model_id", "symbol"), "model_id")
    return rows.select("model_id", "symbol", "value", F.rank().over(Window.partitionBy("symbol").orderBy(F.desc("value"))).alias("place"))


def storage_stats(files: DataFrame) -> DataFrame:
    """(symbol, n, total, mean, latest) of (symbol, size, modified)."""
    return files.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.avg("size").alias("mean"), F.max("modified").alias("latest"))


def delete_model(models: DataFrame, gone: DataFrame) -> DataFrame:
    return models.join(gone.select("model_id"), "model_id", "left_anti")


def stage_events(events: DataFrame) -> DataFrame:
    """(task, stage, started, ended, errors): each task's stages folded from START, END and ERROR rows (task, stage, status, at)."""
    when = lambda s: F.when(F.col("status") == s, F.col("at"))
    return events.groupBy("task", "stage").agg(F.min(when("START")).alias("started"), F.max(when("END")).alias("ended"), F.count_if(F.col("status") == "ERROR").alias("errors"))


def stage_metrics(rows: DataFrame) -> DataFrame:
    """Adds value_float where the text is a number."""
    return rows.withColumn("value_float", F.expr("try_cast(value_text as double)"))


def latest_status(status: DataFrame, key: str = "task") -> DataFrame:
    """(task, status, at): the last row of each task, ties by id."""
    pick = F.max_by(F.struct("status", "at"), F.struct("at", "id"))
    return status.groupBy(key).agg(pick.alias("_l")).select(key, "_l.status", "_l.at")


def pending_tasks(tasks: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """(task, added, status): tasks without status, pending or failed, or running for over an hour; the oldest first."""
    last = latest_status(status)
    rows = tasks.join(last, "task", "left")
    stuck = (F.col("status") == "RUNNING") & (F.col("at") < now - F.expr("interval 1 hour"))
    return rows.where(F.col("status").isNull() | F.col("status").isin("PENDING", "FAILED") | stuck).select("task", "added", "status").orderBy("added", "task")


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return current.unionByName(changes).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ranked_features(features: DataFrame) -> DataFrame:
    """Adds rank_selection and rank_final, by importance within each model, equal ones by name, to (model_id, feature, selection_importance,
    final_importance); a missing importance comes last."""
    place = lambda c: F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc_nulls_last(c), "feature"))
    return features.withColumns({"rank_selection": place("selection_importance"), "rank_final": place("final_importance")})


def finite_metrics(metrics: DataFrame) -> DataFrame:
    """(model_id, metric, value) with a category; values that are missing or not finite are left out."""
    return metrics.withColumn("value", finite(F.col("value"))).where("value is not null").withColumn("category", metric_category("metric"))


def run_log(rows: DataFrame) -> DataFrame:
    """(run_id, started, ended, status): each run folded from START, END and ERROR rows (run_id, event, at). A run with an error has failed, one
    with an end is completed, any other is running."""
    when = lambda s: F.when(F.col("event") == s, F.col("at"))
    out = rows.groupBy("run_id").agg(F.min(when("START")).alias("started"), F.max(when("END")).alias("ended"), F.count_if(F.col("event") == "ERROR").alias("_errors"))
    status = F.when(F.col("_errors") > 0, "FAILED").when(F.col("ended").isNotNull(), "COMPLETED").otherwise("RUNNING")
    return out.select("run_id", "started", "ended", status.alias("status"))


def latest_artifacts(rows: DataFrame) -> DataFrame:
    """The newest path of each (task, stage, kind), ties by path, and how many there were."""
    pick = F.max_by("path", F.struct("at", "path"))
    return rows.groupBy("task", "stage", "kind").agg(pick.alias("path"), F.count("*").alias("n"))


def task_info(tasks: DataFrame, status: DataFrame) -> DataFrame:
    """All columns of tasks with the last status, its time, and whether the task is processed."""
    return tasks.join(latest_status(status), "task", "left").withColumn("processed", F.coalesce(F.col("status") == "COMPLETED", F.lit(False)))
