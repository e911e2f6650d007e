"""Trailing-window operators on series frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from serieslab.core import running, trailing, value_ranks, windowed, with_scalars
from serieslab.operators.sliding import Arrays, by_bucket, moments_of_pairs, quantile, statistics, sums


def gated(values: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    return np.where(n >= least, values, np.nan)


def rolling_stats(df: DataFrame, x: str, k: int, least: int = 1, prefix: str = "") -> DataFrame:
    """mean, std (sample), sum, min and max of the last k rows; null until `least` of them have a value."""
    kinds = ("mean", "std", "sum", "min", "max")

    def made(v: Arrays) -> Arrays:
        s = statistics(v[x], k)
        return {f"{prefix}{n}": gated(s[n], s["n"], least) for n in kinds}

    return by_bucket(df, [x], made, {f"{prefix}{n}": "double" for n in kinds}, back=k - 1)


def rolling_quantile(df: DataFrame, x: str, k: int, q: float = 0.5, least: int = 1, name: str = "median") -> DataFrame:
    """The q quantile of the last k rows, interpolated between neighbours; null until `least` of them have a value."""

    def made(v: Arrays) -> Arrays:
        return {name: gated(quantile(v[x], k, q), sums(np.isfinite(v[x]).astype(float), k), least)}

    return by_bucket(df, [x], made, {name: "double"}, back=k - 1)


def zscore(v: np.ndarray, k: int, least: int) -> np.ndarray:
    s = statistics(v, k)
    return gated((v - s["mean"]) / np.where(s["std"] > 0, s["std"], np.nan), s["n"], least)


def rolling_zscore(df: DataFrame, x: str, k: int = 252, least: int = 50, name: str = "z") -> DataFrame:
    """Distance from the trailing mean in trailing standard deviations; null where these are zero."""
    return by_bucket(df, [x], lambda v: {name: zscore(v[x], k, least)}, {name: "double"}, back=k - 1)


def volume_zscores(df: DataFrame, x: str) -> DataFrame:
    """z over 15 rows (5 needed) and 60 rows (20 needed), and the former a row later."""

    def made(v: Arrays) -> Arrays:
        z = zscore(v[x], 15, 5)
        return {"z15": z, "z60": zscore(v[x], 60, 20), "z15_lag": np.concatenate([[np.nan], z[:-1]])}

    return by_bucket(df, [x], made, {n: "double" for n in ("z15", "z60", "z15_lag")}, back=60)


def shifts(df: DataFrame, x: str, k: int = 1) -> DataFrame:
    """lag, lead, first difference and log return."""
    return windowed(
        df,
        {
            "lag": lambda w: F.lag(x, k).over(w),
            "lead": lambda w: F.lead(x, k).over(w),
            "diff": lambda w: F.col(x) - F.lag(x, 1).over(w),
            "log_return": lambda w: F.when((F.col(x) > 0) & (F.lag(x, 1).over(w) > 0), F.log(x) - F.log(F.lag(x, 1).over(w))),
        },
        back=max(k, 1),
        ahead=k,
    )


def rolling_relationship(df: DataFrame, a: str, b: str, k: int, name: str = "relationship") -> DataFrame:
    """Product of the two trailing means over the sum of their sizes, cut to [-1, 1]; null where a window has no value."""

    def made(w: WindowSpec) -> Column:
        ma, mb = F.avg(a).over(trailing(w, k)), F.avg(b).over(trailing(w, k))
        return F.when(ma.isNotNull() & mb.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ma * mb / (F.abs(ma) + F.abs(mb) + 1e-8))))

    return windowed(df, {name: made}, back=k - 1)


def rolling_corr(df: DataFrame, a: str, b: str, k: int, least: int, name: str = "corr") -> DataFrame:
    """Pearson correlation over the last k rows; null while fewer than `least` rows have both values, or one is constant."""

    def made(v: Arrays) -> Arrays:
        m = moments_of_pairs(v[a], v[b], k)
        spread = np.sqrt(m["xx"]) * np.sqrt(m["yy"])
        return {name: gated(np.clip(m["xy"] / np.where(spread > 0, spread, np.nan), -1, 1), m["n"], least)}

    return by_bucket(df, [a, b], made, {name: "double"}, back=k - 1)


def rolling_coverage(df: DataFrame, x: str, k: int, least: int, name: str = "covered") -> DataFrame:
    """Whether at least `least` of the last k rows have a value."""
    return windowed(df, {name: lambda w: F.count(x).over(trailing(w, k)) >= least}, back=k - 1)


def rolling_vol(df: DataFrame, y: str, k: int = 50, least: int = 10, floor: float = 1e-6, name: str = "sigma") -> DataFrame:
    """Trailing standard deviation; where that is missing the one of all rows so far; at least `floor`."""

    def made(v: Arrays) -> Arrays:
        s = statistics(v[y], k)
        return {"_std": gated(s["std"], s["n"], least)}

    own = with_scalars(by_bucket(df, [y], made, {"_std": "double"}, back=k - 1), df.groupBy("series").agg(F.avg(y).alias("_mean")))
    v = F.col(y) - F.col("_mean")  # sums of squares far from zero would cancel
    sums_of = running(own, {"_n": F.when(v.isNotNull(), 1), "_sum": v, "_sq": v * v})
    n, s, q = F.col("_n"), F.col("_sum"), F.col("_sq")
    so_far = F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    return sums_of.withColumn(name, F.greatest(F.coalesce("_std", so_far, F.lit(floor)), F.lit(floor))).drop("_std", "_mean", "_n", "_sum", "_sq")


def df_t(slope: Column, sxx: Column, syy: Column, m: Column) -> Column:
    """t statistic of the slope from the sums of a regression with intercept; null without spread or with two rows or fewer."""
    rss = F.greatest(syy - slope * slope * sxx, F.lit(0.0))
    return F.when((sxx > 0) & (m > 2) & (rss > 0), slope / F.sqrt(rss / (m - 2) / sxx))


def rolling_df_tstat(df: DataFrame, x: str, k: int = 252, least: int = 200, name: str = "adf_t") -> DataFrame:
    """t statistic of the Dickey-Fuller regression (difference on level before it) over the last k rows."""

    def made(v: Arrays) -> Arrays:
        before = np.concatenate([[np.nan], v[x][:-1]])
        m = moments_of_pairs(before, v[x] - before, k - 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            slope = m["xy"] / np.where(m["xx"] > 0, m["xx"], np.nan)
            rss = np.maximum(m["yy"] - slope * slope * m["xx"], 0.0)
            t = slope / np.sqrt(np.where((rss > 0) & (m["n"] > 2), rss, np.nan) / (m["n"] - 2) / m["xx"])
        return {name: gated(t, m["n"], least - 1)}

    return by_bucket(df, [x], made, {name: "double"}, back=k - 1)


def cyclical_components(df: DataFrame, x: str, periods: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """Distance from the trailing mean over each period."""
    made = {f"cycle_{p}": (lambda w, p=p: F.col(x) - F.avg(x).over(trailing(w, p))) for p in periods}
    return windowed(df, made, back=max(periods) - 1)


def average_ranks(df: DataFrame, x: str, name: str = "rank", by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Rank of each value in its series (or other group) from 1, ties sharing the mean of theirs; null values have none."""
    ranks = value_ranks(df, x, list(by)).select(*by, F.col("value").alias(x), (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return with_scalars(df, ranks, "left", [*by, x])


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
