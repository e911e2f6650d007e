"""A null series is one like any other: it has the results that the same rows have under a name."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab.operators import columns, dependence, labels, metrics, rolling, sampling, stationary, stats, volatility

OPERATORS = {
    "ensure_finite": lambda d: columns.ensure_finite(d, ["g"]),
    "fill_both_ways": lambda d: columns.fill_both_ways(d, ["g"]),
    "impute": lambda d: columns.impute(d, ["g"]),
    "series_quality": lambda d: columns.series_quality(d, "x"),
    "rolling_stats": lambda d: rolling.rolling_stats(d, "g", 20, 5),
    "rolling_corr": lambda d: rolling.rolling_corr(d, "x", "y", 20, 5),
    "rolling_vol": lambda d: rolling.rolling_vol(d, "r"),
    "average_ranks": lambda d: rolling.average_ranks(d, "y"),
    "shifts": lambda d: rolling.shifts(d, "x"),
    "tail_sample": lambda d: sampling.tail_sample(d, 30),
    "systematic_sample": lambda d: sampling.systematic_sample(d, 17),
    "time_split": lambda d: sampling.time_split(d),
    "expanding_splits": lambda d: sampling.expanding_splits(d, 3),
    "purged_kfold": lambda d: sampling.purged_kfold(d, 3, 5, 5),
    "fold_bits": lambda d: sampling.fold_bits(d, sampling.cpcv_roles(4, 2, 5, 5)),
    "variance_stabilised": lambda d: stationary.variance_stabilised(d, "x"),
    "fracdiff": lambda d: stationary.fracdiff(d, "x", 0.4, 15),
    "fill_borders": lambda d: stationary.fill_borders(stationary.baxter_king(d, "x"), "x", 12, "bk"),
    "seasonal_decompose": lambda d: stationary.seasonal_decompose(d, "x", 7),
    "correlation_matrix": lambda d: stats.correlation_matrix(d, ["x", "y"]),
    "summaries": lambda d: stats.summaries(d, ["x", "y"]),
    "hist_entropy": lambda d: stats.hist_entropy(d, "x"),
    "variance_ratio": lambda d: stats.variance_ratio(d, "x"),
    "adf_test": lambda d: stats.adf_test(d, "x"),
    "spearman_ic": lambda d: metrics.spearman_ic(d, "x", "y"),
    "auc_roc": lambda d: metrics.auc_roc(d, "c", "y"),
    "average_precision": lambda d: metrics.average_precision(d, "c", "y"),
    "precision_at_top": lambda d: metrics.precision_at_top(d, "c", "y", 0.2, "idx"),
    "diebold_mariano": lambda d: metrics.diebold_mariano(d, "r", "y"),
    "vol_adjusted": lambda d: metrics.vol_adjusted_metrics(d, "r", "y", "x"),
    "winsorised": lambda d: labels.winsorised(d, "y", 0.1, 0.9),
    "vol_scaled": lambda d: labels.vol_scaled(d, "r", mode="constant"),
    "triple_barrier": lambda d: labels.triple_barrier(d, "x", 0.002, 0.001, 20),
    "barrier_sweep": lambda d: labels.barrier_sweep(d, "x"),
    "attach_by_position": lambda d: __import__("serieslab.operators.relations", fromlist=["x"]).attach_by_position(d.select("series", "idx", "x"), d.select("series", "idx", "y")),
    "conditional_variance": lambda d: volatility.conditional_variance(volatility.log_returns(d, "x"), volatility.garch_fit(d, "x")),
    "distance_corr": lambda d: dependence.distance_corr(d, "y", ["x"], 100, ["series"]),
    "dcor_rolling": lambda d: dependence.dcor_rolling(d, "y", ["x"], 100, 50, 10),
}


@pytest.fixture(scope="module")
def named(spark):
    rng = np.random.default_rng(12)
    rows = []
    for s in ("a", "b"):
        x = np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
        rows += [(s, i, float(v), None if i % 9 == 0 else float(v), float(np.round(rng.normal(), 1)), int(rng.random() < 0.4), float(rng.normal())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series string, idx long, x double, g double, y double, c int, r double").repartition(3)


def spelled(rows) -> list[str]:
    plain = lambda v: round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted(repr({k: plain(v) for k, v in r.asDict().items()}) for r in rows)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_null_is_a_series(named, name):
    want = OPERATORS[name](named)
    got = OPERATORS[name](named.withColumn("series", F.when(F.col("series") == "a", F.col("series"))))
    back = got.withColumn("series", F.coalesce("series", F.lit("b"))).select(*want.columns).collect()
    assert back and spelled(back) == spelled(want.collect())
