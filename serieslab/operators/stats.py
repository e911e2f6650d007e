"""Statistics and tests by series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.core import halo, matched, materialise, quantiles, ratio, safe_corr, trailing, unpivoted, windowed, with_scalars
from serieslab.operators.rolling import df_t
from serieslab.operators.stationary import fracdiff_grid, spectral_features, stepped_p, variance_stabilised


def df_test(df: DataFrame, x: str) -> DataFrame:
    """(series, n, t, p): Dickey-Fuller regression of each series; p is a step function, 1 under 50 rows."""
    y = windowed(df, {"_b": lambda w: F.lag(x).over(w)}, back=1).withColumn("_d", F.col(x) - F.col("_b"))
    t = df_t(F.regr_slope("_d", "_b"), F.regr_sxx("_d", "_b"), F.regr_syy("_d", "_b"), F.regr_count("_d", "_b"))
    rows = y.groupBy("series").agg(F.count(x).alias("n"), t.alias("t"))
    return rows.withColumn("p", F.when(F.col("n") < 50, 1.0).otherwise(stepped_p(F.col("t"))))


def variance_ratio(df: DataFrame, x: str, lags: tuple[int, ...] = (2, 4, 8, 16), least: int = 100) -> DataFrame:
    """(series, ratio, stationary): variance of sums of q differences over q times that of one, averaged over q; near one for a walk."""
    d = windowed(df, {"_d": lambda w: F.col(x) - F.lag(x).over(w)}, back=1).where("_d is not null")
    base = d.groupBy("series").agg(F.var_pop("_d").alias("_v"), F.count("_d").alias("_n"))
    each = d.select("series", "idx", "_d", F.explode(F.array(*[F.lit(q) for q in lags])).alias("q"))
    sums = each.groupBy("series", "q", F.floor((F.col("idx") - 1) / F.col("q")).alias("_g")).agg(F.sum("_d").alias("_s"), F.count("*").alias("_c")).where("_c = q")
    by_q = sums.groupBy("series", "q").agg(F.var_pop("_s").alias("_vq")).transform(matched, base, "series").where("_n >= 2 * q and _v > 0")
    out = by_q.groupBy("series").agg(F.avg(F.col("_vq") / (F.col("q") * F.col("_v"))).alias("ratio"), F.first("_n").alias("_n")).where(F.col("_n") + 1 >= least)
    return out.select("series", "ratio", (F.abs(F.col("ratio") - 1) < 0.1).alias("stationary"))


def moments(df: DataFrame, x: str, by: str = "series") -> DataFrame:
    """mean, population std, skewness and raw kurtosis; the last two are 0 for a constant."""
    flat = F.stddev_pop(x) == 0
    return df.groupBy(by).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.when(flat, 0.0).otherwise(F.skewness(x)).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis(x) + 3).alias("kurt")
    )


def summaries(df: DataFrame, columns: list[str], mask: Column | None = None) -> DataFrame:
    """(series, feature, count, mean, std, min, max, median, skew, kurt), over the rows that the mask admits."""
    rows = unpivoted(df.where(mask) if mask is not None else df, columns).where("value is not null")
    out = rows.groupBy("series", "feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("skew"), (F.kurtosis("value") + 3).alias("kurt"),
    )
    middle = quantiles(rows, "value", ["series", "feature"], [0.5], "_q").select("series", "feature", F.col("_q")[0].alias("median"))
    return matched(out, middle, ["series", "feature"])


def autocorr(df: DataFrame, x: str, lags: list[int]) -> DataFrame:
    """(series, lag, r): correlation with the value `lag` rows before; 0 where one side is constant, NaN where one has a
    NaN."""
    at = windowed(df, {f"_l{k}": (lambda w, k=k: F.lag(x, k).over(w)) for k in lags}, back=max(lags))
    row = at.groupBy("series").agg(*[safe_corr(x, f"_l{k}").alias(str(k)) for k in lags])
    long = row.unpivot(["series"], [str(k) for k in lags], "lag", "r")
    return long.select("series", F.col("lag").cast("int").alias("lag"), F.coalesce("r", F.lit(0.0)).alias("r"))


def trend_strength(df: DataFrame, x: str) -> DataFrame:
    """Size of the slope on the row number over the standard deviation."""
    return df.groupBy("series").agg((F.abs(F.regr_slope(x, "idx")) / (F.stddev_pop(x) + 1e-9)).alias("trend"))


def hist_entropy(df: DataFrame, x: str, most: int = 50) -> DataFrame:
    """(series, bins, entropy) of an equal-width histogram of min(most, n / 10) bins, the last one closed."""
    edge = df.groupBy("series").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.least(F.lit(most), F.floor(F.count(x) / 10)).cast("int").alias("bins")).where("bins > 0 and _hi > _lo")
    binned = df.where(F.col(x).isNotNull()).transform(with_scalars, edge).withColumn("_b", F.least(F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("bins")), F.col("bins") - 1))
    counts = binned.groupBy("series", "bins", "_b").agg(F.count("*").alias("_c"))
    total = counts.groupBy("series").agg(F.sum("_c").alias("_n"))
    p = F.col("_c") / F.col("_n")
    return matched(counts, total, "series").groupBy("series", "bins").agg((-F.sum(p * F.log(p + 1e-9))).alias("entropy"))


def correlation_matrix(df: DataFrame, columns: list[str], least: int = 10, size: int = 50_000) -> DataFrame:
    """(series, a, b, r) for every pair of columns, over the rows that have both; 0 with `least` such rows or fewer, or for a constant.

    Each bucket of rows gives matrices of counts, sums and products of the values less their mean; these are added up by series."""
    p, kind = len(columns), dict(df.dtypes)["series"]
    means = df.groupBy("series").agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    rows = with_scalars(df, means).select("series", F.floor(F.col("idx") / size).alias("_bucket"), *[(F.col(c) - F.col(f"_m{i}")).alias(f"v{i}") for i, c in enumerate(columns)])
    above = np.triu_indices(p, 1)

    def products(g: pd.DataFrame) -> pd.DataFrame:
        v = g[[f"v{i}" for i in range(p)]].to_numpy(float)
        has = (~np.isnan(v)).astype(float)
        v = np.nan_to_num(v)
        n, sx, sxx, sxy = has.T @ has, v.T @ has, (v * v).T @ has, v.T @ v
        own = {"i": above[0], "j": above[1], "n": n[above], "sx": sx[above], "sy": sx.T[above], "sxx": sxx[above], "syy": sxx.T[above], "sxy": sxy[above]}
        return pd.DataFrame({"series": g["series"].iat[0], **own})

    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = rows.groupBy("series", "_bucket").applyInPandas(products, f"series {kind}, i int, j int, " + ", ".join(f"{c} double" for c in names))
    s = parts.groupBy("series", "i", "j").agg(*[F.sum(c).alias(c) for c in names])
    vx, vy = (F.col("n") * F.col(f"s{c}{c}") - F.col(f"s{c}") ** 2 for c in "xy")
    varies = (vx > 1e-12 * F.col("n") * F.col("sxx")) & (vy > 1e-12 * F.col("n") * F.col("syy"))
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy))
    name = F.array(*[F.lit(c) for c in columns])
    return s.select("series", name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), F.when((F.col("n") > least) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(0.0).alias("r"))


def jarque_bera(df: DataFrame, x: str, by: str = "series") -> DataFrame:
    m = df.groupBy(by).agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"))
    return m.select(by, "n", (F.col("n") * (F.col("s") ** 2 / 6 + F.col("k") ** 2 / 24)).alias("jb"))


#: Rows of a bucket whose lags are held side by side.
LAGGED_ROWS = 4096


def adf_test(df: DataFrame, x: str, lags: int | None = None, trend: bool = True, drop_warmup: bool = True) -> DataFrame:
    """(series, t, p_step, lags, n, stationary): Dickey-Fuller regression with lagged differences, constant and trend.

    Without `lags` each series takes int(12 (n / 100)^(1/4)) of its own n values. Haloed buckets of rows give the sums of the regressors'
    products, which are added up by series; the small system of each series is then solved. With drop_warmup=False lags that a row
    lacks count as zero. The p value is a step function of critical values for a regression without trend."""
    kind, chunk = dict(df.dtypes)["series"], LAGGED_ROWS
    own = F.lit(lags) if lags is not None else F.floor(12 * F.pow(F.col("_n") / 100, F.lit(0.25)))
    counts = materialise(df.where(F.col(x).isNotNull()).groupBy("series").agg(F.count("*").alias("_n")).select("series", own.cast("int").alias("_lags")))
    most = counts.agg(F.max("_lags")).first()[0] or 0
    rows = halo(df.select("series", "idx", F.col(x).cast("double").alias("_x")), back=most + 1).transform(with_scalars, counts)

    def products(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        k, v = int(g["_lags"].iat[0]), g["_x"].to_numpy(float)
        before, d = (np.full(len(v), np.nan) for _ in range(2))
        before[1:], d[1:] = v[:-1], v[1:] - v[:-1]
        padded, at, home, s = np.concatenate([np.full(k, np.nan), d]), g["idx"].to_numpy(float) / 1000, g["_home"].to_numpy(bool), 0.0
        for lo in range(0, len(v), chunk):
            hi = min(lo + chunk, len(v))
            lagged = np.stack([padded[k - j + lo : k - j + hi] for j in range(1, k + 1)], axis=1) if k else np.empty((hi - lo, 0))
            if not drop_warmup:
                lagged = np.nan_to_num(lagged)
            m = np.column_stack([before[lo:hi], lagged, np.ones(hi - lo), *([at[lo:hi]] if trend else []), d[lo:hi]])
            m = m[home[lo:hi] & ~np.isnan(m).any(axis=1)]
            s = s + m.T @ m
        i, j = np.triu_indices(len(s))
        return pd.DataFrame({"series": g["series"].iat[0], "lags": k, "i": i, "j": j, "s": s[i, j]})

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        size = int(g["j"].max())  # the last row and column hold the regressand
        a = np.zeros((size + 1, size + 1))
        a[g["i"], g["j"]] = a[g["j"], g["i"]] = g["s"]
        k = int(g["lags"].iat[0])
        n, t = int(round(a[k + 1, k + 1])), None
        if n > max(50, size):
            inv = np.linalg.pinv(a[:size, :size])
            beta = inv @ a[:size, size]
            rss = max(float(a[size, size] - beta @ a[:size, size]), 0.0)
            se = np.sqrt(rss / (n - size) * max(inv[0, 0], 0.0))
            t = float(beta[0] / se) if se > 0 else None
        p = None if t is None else 0.01 if t <= -3.43 else 0.05 if t <= -2.86 else 0.10 if t <= -2.57 else 1.0
        return pd.DataFrame([(g["series"].iat[0], t, p, k, n, bool(p is not None and p <= 0.05))], columns=["series", "t", "p_step", "lags", "n", "stationary"])

    sums = rows.groupBy("series", "_bucket").applyInPandas(products, f"series {kind}, lags int, i int, j int, s double").groupBy("series", "lags", "i", "j").agg(F.sum("s").alias("s"))
    return sums.groupBy("series").applyInPandas(solve, f"series {kind}, t double, p_step double, lags int, n bigint, stationary boolean")


def adf_batch(df: DataFrame, columns: list[str], lags: int = 4) -> DataFrame:
    """adf_test of each column: (series, feature, t, p_step, lags, n, stationary). All columns are tested in the same jobs, each pair of
    column and series as a series of its own."""
    name = F.array(*[F.lit(c) for c in columns])
    key = F.concat_ws("|", F.array_position(name, F.col("feature")).cast("string"), F.col("series").cast("string"))  # no bar: a null series
    found = adf_test(unpivoted(df, columns).select(key.alias("series"), "idx", "value"), "value", lags)
    place, bar = F.substring_index("series", "|", 1), F.instr("series", "|")
    own = F.when(bar > 0, F.expr("substring(series, instr(series, '|') + 1)")).cast(dict(df.dtypes)["series"])
    return found.select(own.alias("series"), F.element_at(name, place.cast("int")).alias("feature"), "t", "p_step", "lags", "n", "stationary")


def feature_profile(df: DataFrame, x: str, windows: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """(series, measure, value): variance ratio, autocorrelation, trend, histogram entropy, moments, means of the spectral features over the
    blocks, and of each fractional difference t, p and variance ratio. The columns of feature_columns come as their mean and standard
    deviation."""
    grid = fracdiff_grid(df, x)
    made = feature_columns(df.select("series", "idx", x), x, windows)
    names = [c for c in made.columns if c not in ("series", "idx", x)]
    averages = made.groupBy("series").agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    parts = [
        variance_ratio(df, x).select("series", F.lit("variance_ratio").alias("measure"), F.col("ratio").alias("value")),
        autocorr(df, x, [1, 5, 10]).select("series", F.concat(F.lit("autocorr_"), F.col("lag").cast("string")).alias("measure"), F.col("r").alias("value")),
        trend_strength(df, x).select("series", F.lit("trend").alias("measure"), F.col("trend").alias("value")),
        hist_entropy(df, x).select("series", F.lit("entropy").alias("measure"), F.col("entropy").alias("value")),
        moments(df, x).unpivot(["series"], ["mean", "std", "skew", "kurt"], "measure", "value"),
        spectral_features(df, x).groupBy("series").agg(*[F.avg(c).alias(f"spectral_{c}") for c in ("dominant", "entropy", "centroid")]).unpivot(["series"], [f"spectral_{c}" for c in ("dominant", "entropy", "centroid")], "measure", "value"),
        grid.withColumn("d", F.col("d").cast("string")).unpivot(["series", "d"], ["t", "p", "var_ratio"], "_name", "value").select("series", F.concat(F.lit("frac_diff_d"), "d", F.lit("_"), "_name").alias("measure"), "value"),
        averages.unpivot(["series"], [c for c in averages.columns if c != "series"], "measure", "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_columns(df: DataFrame, x: str, windows: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """Adds rolling mean, std, min and max and the distance from the rolling mean for each window, and x stabilised by logarithm and by
    root. All windows are taken in one pass over haloed buckets."""
    made = {f"rolling_{n}_{k}": (lambda w, f=f, k=k: f(x).over(trailing(w, k))) for k in windows for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))}
    made |= {f"cycle_{k}": (lambda w, k=k: F.col(x) - F.avg(x).over(trailing(w, k))) for k in windows}
    out = windowed(df, made, back=max(windows) - 1)
    for kind in ("log", "sqrt"):
        out = variance_stabilised(out, x, kind, f"stabilised_{kind}")
    return out
