"""The whole way from a raw series to ranked features, and sinks read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.core import materialise
from serieslab.operators.labels import forward_log_return
from serieslab.operators.metrics import best_pairs
from serieslab.operators.rolling import cyclical_components, rolling_zscore
from serieslab.operators.selection import multi_target_sweep, select_features
from serieslab.operators.stationary import baxter_king, fracdiff, variance_stabilised
from serieslab.plans.frames import E, events_series
from serieslab.plans.stages import Stage, run_stages

FEATURES = ["x_z", "x_fd", "x_bk", "x_log", "cycle_20"]
STAGES = [
    Stage("z-score", ("x",), lambda d: rolling_zscore(d, "x", 20, 5, "x_z")),
    Stage("fractional difference", ("x",), lambda d: fracdiff(d, "x", 0.4, 15, name="x_fd")),
    Stage("band pass", ("x",), lambda d: baxter_king(d, "x", name="x_bk")),
    Stage("variance", ("x",), lambda d: variance_stabilised(d, "x", "log", "x_log")),
    Stage("cycles", ("x",), lambda d: cyclical_components(d, "x", (20,))),
    Stage("target", ("x",), lambda d: forward_log_return(forward_log_return(d, "x", 5, "y_5"), "x", 10, "y_10")),
]
#: Trees grow with the parameters in force; the score filter lets all features pass.
FIT = {"least": 0.0, "nmi": 0.5, "least_train": 10}


def features_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series of all events with features and targets; each stage is a few windows over haloed buckets."""
    rows, _ = run_stages(events_series(spark, sf_dir).select("series", "idx", "x"), STAGES)
    return materialise(rows.dropna(subset=[*FEATURES, "y_5", "y_10"]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, feature, score, kept) of the selection for the 10-row target."""
    return select_features(features_of_events(spark, sf_dir), "y_10", FEATURES, **FIT)


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_target_sweep(features_of_events(spark, sf_dir), ["y_5", "y_10"], FEATURES, **FIT)


def _stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(events_series(spark, sf_dir), STAGES[:2])[1]


def _best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_series(spark, sf_dir).groupBy(F.col("series").alias("horizon"), F.col("user_id").cast("string").alias("name")).agg(F.round(F.avg("x"), 6).alias("r2"))
    return best_pairs(rows, 2)


QUERIES = {"flagship": flagship, "multi_target_sweep": _sweep, "stage_log": _stage_log, "best_pairs": _best_pairs}
ORACLE_SQL = {
    "stage_log": f"WITH {E}, n AS (SELECT count(*) AS n FROM e) SELECT 'z-score' AS stage, n AS rows_before, n AS rows_after, 6 AS cols_before, 7 AS cols_after, 'x_z' AS new_cols FROM n UNION ALL SELECT 'fractional difference', n, n, 7, 8, 'x_fd' FROM n",
    "best_pairs": f"WITH {E}, r AS (SELECT series AS horizon, user_id::VARCHAR AS name, round(avg(x), 6) AS r2 FROM e GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY r2 DESC, name)::INTEGER AS place FROM r QUALIFY place <= 2",
}
