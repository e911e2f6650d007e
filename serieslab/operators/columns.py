"""Columns by role, projections, gates on quality, and issues as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.core import filled, finite, quantiles, trailing, windowed, with_scalars

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
#: Name parts by which columns get a role, and prefixes that must not be features.
ROLES = {"price": ("close", "open", "high", "low"), "return": ("ret",), "volume": ("volume",), "volatility": ("vol_", "rv_", "atr"), "spread": ("spread",), "ofi": ("ofi",)}
TARGETS = ("y_ret_fwd_", "m1_", "m2_", "m3_", "m4_", "m5_", "m6_", "m7_", "m8_", "m9_")
DIAGNOSTICS = ("dcor_", "adf_", "stage1_", "cpcv_")


def columns_by_role(df: DataFrame) -> dict[str, list[str]]:
    """Column names by role, from their names; targets and diagnostics first."""
    out: dict[str, list[str]] = {r: [] for r in ("target", "metric", *ROLES)}
    for c in df.columns:
        if c.startswith(TARGETS):
            out["target"].append(c)
        elif c.startswith(DIAGNOSTICS):
            out["metric"].append(c)
        else:
            for role, parts in ROLES.items():
                if any(p in c for p in parts) and (role != "price" or c.startswith("y_")):
                    out[role].append(c)
                    break
    return out


def drop_denied(df: DataFrame, exact: list[str], prefixes: list[str] = (), protected: list[str] = ()) -> DataFrame:
    gone = [c for c in df.columns if c not in protected and (c in exact or c.startswith(tuple(prefixes) or ("\x00",)))]
    return df.drop(*gone)


def candidate_features(df: DataFrame, allow: tuple[str, ...] = (), denied: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are no target, metric or denied, and whose names mark features."""
    kinds = dict(df.dtypes)
    marked = lambda c: "frac_diff" in c or c.startswith(("y_", "x_", *allow))
    return [c for c in df.columns if kinds[c] in NUMERIC and not c.startswith((*TARGETS, *DIAGNOSTICS)) and c not in denied and marked(c)]


def eligible_float_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float") and not c.startswith((*TARGETS, *DIAGNOSTICS)) and c not in exclude]


def leakage_guard(features: DataFrame, feature: str = "feature") -> DataFrame:
    """Adds leaks: whether a feature's name says that it holds the future or a diagnostic."""
    met = [F.startswith(F.col(feature), F.lit(p)) for p in (*TARGETS[:1], *DIAGNOSTICS)]
    return features.withColumn("leaks", F.coalesce(F.array_contains(F.array(*met), F.lit(True)), F.lit(False)))


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without the columns that have at most one distinct value. One row of extremes comes back."""
    ends = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if ends[c]["lo"] == ends[c]["hi"]])


def drop_incomplete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns}).dropna(subset=columns)


def ensure_finite(df: DataFrame, columns: list[str], leading: float = 0.0) -> DataFrame:
    """Without NaN and infinities: the last finite value before, and a constant where there is none."""
    out = filled(df.withColumns({c: finite(F.col(c)) for c in columns}), columns)
    return out.withColumns({c: F.coalesce(c, F.lit(leading)) for c in columns})


def fill_both_ways(df: DataFrame, columns: list[str]) -> DataFrame:
    return filled(filled(df, columns), columns, forward=False)


def impute(df: DataFrame, columns: list[str], method: str = "median", most_missing: float = 1.0) -> DataFrame:
    """Missing values by the series' median, or filled forward, backward or both ways; columns with more missing than the share go."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    kept = [c for c in columns if (shares[c] or 0) <= most_missing]
    df = df.drop(*[c for c in columns if c not in kept])
    if method == "median":
        for c in kept:
            middle = quantiles(df, c, ["series"], [0.5], "_m")
            df = with_scalars(df, middle, "left").withColumn(c, F.coalesce(c, F.col("_m")[0])).drop("_m")
        return df
    return {"ffill": lambda: filled(df, kept), "bfill": lambda: filled(df, kept, forward=False), "both": lambda: fill_both_ways(df, kept)}[method]()


def validate_schema(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """(level, column, message): what is missing, of another type, doubled or empty."""
    kinds, out = dict(df.dtypes), []
    for c, t in required.items():
        if c not in kinds:
            out.append(("error", c, "missing"))
        elif kinds[c] != t:
            out.append(("warning", c, f"{kinds[c]} instead of {t}"))
    out += [("error", c, "doubled") for c in sorted({c for c in df.columns if df.columns.count(c) > 1})]
    if df.limit(1).count() == 0:
        out.append(("error", "", "no rows"))
    return df.sparkSession.createDataFrame(out, "level string, column string, message string")


def null_inf_report(df: DataFrame, columns: list[str], limit: float = 50.0) -> DataFrame:
    """(feature, null_pct, inf_count, flagged) in one pass."""
    inf = lambda c: F.count_if(F.abs(F.col(c).cast("double")) == float("inf"))
    row = df.agg(*[F.struct(F.lit(c).alias("feature"), (F.avg(F.col(c).isNull().cast("double")) * 100).alias("null_pct"), inf(c).alias("inf_count")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*columns)).alias("x")).select("x.*").withColumn("flagged", F.col("null_pct") > limit)


def series_quality(df: DataFrame, x: str, windows: tuple[int, ...] = (10, 20, 50), least: int = 100, missing: float = 20.0) -> DataFrame:
    """(series, n, missing_pct, flat_share, outlier_share, passed). flat_share is the largest share, over the windows, of rows whose trailing
    deviation is under 1e-8 (a missing one counts as 0)."""
    made = {}
    for k in windows:
        made[f"_f{k}"] = lambda w, k=k: (F.coalesce(F.when(F.count(x).over(trailing(w, k)) >= max(3, k // 2), F.stddev_samp(x).over(trailing(w, k))), F.lit(0.0)) < 1e-8).cast("double")
    own = windowed(df, made, back=max(windows) - 1)
    m = own.groupBy("series").agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    out = own.transform(with_scalars, m).groupBy("series").agg(
        F.count("*").alias("n"), (F.avg(F.col(x).isNull().cast("double")) * 100).alias("missing_pct"), F.greatest(*[F.avg(f"_f{k}") for k in windows], F.lit(0.0)).alias("flat_share"),
        F.avg(F.coalesce((F.abs(F.col(x) - F.col("_m")) > 3 * F.col("_s")).cast("double"), F.lit(0.0))).alias("outlier_share"),
    )
    good = (F.col("n") >= least) & (F.col("missing_pct") <= missing) & (F.col("flat_share") < 0.8) & (F.col("outlier_share") < 0.2)
    return out.withColumn("passed", good)


def stage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: columns and rows before and after, and the new columns."""
    new = [c for c in after.columns if c not in before.columns]
    rows = before.agg(F.count("*").alias("rows_before")).join(F.broadcast(after.agg(F.count("*").alias("rows_after"))))  # one row each
    return rows.withColumns({"cols_before": F.lit(len(before.columns)), "cols_after": F.lit(len(after.columns)), "new_cols": F.lit(",".join(new))})


def data_alerts(metrics: DataFrame) -> DataFrame:
    """(stage, alert) of (stage, features, expected, null_pct, seconds, usual)."""
    each = F.filter(
        F.array(
            F.when(F.abs(F.col("features") - F.col("expected")) > 0.5 * F.col("expected"), F.lit("features")),
            F.when(F.col("null_pct") > 50, F.lit("nulls")),
            F.when(F.col("seconds") > 1.5 * F.col("usual"), F.lit("slow")),
        ),
        F.isnotnull,
    )
    return metrics.select("stage", F.explode(each).alias("alert"))


