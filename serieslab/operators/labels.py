"""Targets, labels and session masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.core import matched, quantiles, ratio, sized, windowed, with_scalars
from serieslab.operators.rolling import rolling_coverage, rolling_vol
from serieslab.operators.sliding import Arrays, by_bucket, first_at_least


def forward_log_return(df: DataFrame, p: str, h: int, name: str = "y") -> DataFrame:
    return windowed(df, {name: lambda w: F.when((F.col(p) > 0) & (F.lead(p, h).over(w) > 0), F.log(F.lead(p, h).over(w) / F.col(p)))}, ahead=h)


def direction_label(df: DataFrame, p: str, h: int = 5, name: str = "label") -> DataFrame:
    """1 if the price h rows on is higher, else 0; rows without that row are dropped."""
    out = windowed(df, {"_ahead": lambda w: F.lead(p, h).over(w)}, ahead=h).where(F.col("_ahead").isNotNull() & F.col(p).isNotNull())
    return out.withColumn(name, (F.col("_ahead") > F.col(p)).cast("int")).drop("_ahead")


def touches(p: np.ndarray, tp: np.ndarray, sl: np.ndarray, limit: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """label, periods and ret of `triple_barrier`; NaN labels where the rows ahead do not suffice."""
    up, down = first_at_least(p, p * (1 + tp), least, limit), first_at_least(-p, -p * (1 - sl), least, limit)
    u, d = np.where(np.isnan(up), np.inf, up), np.where(np.isnan(down), np.inf, down)
    label = np.where((u < np.inf) & (u <= d), 1.0, np.where(d < np.inf, -1.0, 0.0))
    at = np.minimum(np.minimum(u, d), limit).astype(int)
    ahead = np.concatenate([p, np.full(limit + least + 1, np.nan)])
    rows = np.arange(len(p))
    ret = ahead[rows + at] / np.where(p != 0, p, np.nan) - 1
    enough = np.isfinite(ahead[rows + limit + least])
    return np.where(enough, label, np.nan), np.where(enough, at, np.nan), np.where(enough, ret, np.nan)


def triple_barrier(df: DataFrame, p: str, tp: float | Column = 0.002, sl: float | Column = 0.001, limit: int = 60, least: int = 5) -> DataFrame:
    """Adds label (1: the upper barrier p (1 + tp) is touched first among rows least .. limit ahead, or together with the lower one; -1: the
    lower barrier p (1 - sl); 0: none), periods and ret (null for a zero price). The last limit + least rows of a series have no label and are dropped.
    The first touch is searched in a table of greatest prices over powers of two, so its cost hardly grows with the limit."""
    rows = df.withColumns({"_tp": tp if isinstance(tp, Column) else F.lit(tp), "_sl": sl if isinstance(sl, Column) else F.lit(sl)})
    names = ("label", "periods", "ret")
    out = by_bucket(rows, [p, "_tp", "_sl"], lambda v: dict(zip(names, touches(v[p], v["_tp"], v["_sl"], limit, least), strict=True)), {"label": "int", "periods": "int", "ret": "double"}, ahead=limit + least)
    return out.where("label is not null").drop("_tp", "_sl")


def label_summary(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, n, share, periods, ret) and, on every row, the expected return, win rate and score of the group."""
    each = labels.groupBy(*by, "label").agg(F.count("*").alias("n"), F.avg("periods").alias("periods"), F.avg("ret").alias("ret"))
    whole = labels.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("ret").alias("expected"), F.avg((F.col("label") == 1).cast("double")).alias("win_rate"))
    out = matched(each, whole, by).withColumn("share", F.col("n") / F.col("_n")).withColumn("score", F.col("win_rate") * 100 * F.col("expected") * 1000)
    return out.select(*by, "label", "n", "share", "periods", "ret", "expected", "win_rate", "score")


#: The named barrier settings (name, tp, sl, limit).
BARRIERS = [("Conservative", 0.001, 0.0005, 30), ("Moderate", 0.002, 0.001, 60), ("Aggressive", 0.003, 0.0015, 90), ("Wide", 0.005, 0.002, 120)]


def barrier_sweep(df: DataFrame, p: str, settings: list[tuple] = BARRIERS, least: int = 5) -> DataFrame:
    """(series, name, n, win_rate, expected, score) of each setting, all from one pass."""
    kinds = {f"{n}{i}": t for i in range(len(settings)) for n, t in (("label", "int"), ("ret", "double"))}

    def made(v: Arrays) -> Arrays:
        found = [touches(v[p], np.full(len(v[p]), tp), np.full(len(v[p]), sl), limit, least) for _, tp, sl, limit in settings]
        return {f"{n}{i}": t[at] for i, t in enumerate(found) for n, at in (("label", 0), ("ret", 2))}

    rows = by_bucket(df.select("series", "idx", p), [p], made, kinds, ahead=max(s[3] for s in settings) + least)
    sums = rows.groupBy("series").agg(*[
        F.struct(F.lit(s[0]).alias("name"), F.count(f"label{i}").alias("n"), F.avg(F.when(F.col(f"label{i}").isNotNull(), (F.col(f"label{i}") == 1).cast("double"))).alias("win_rate"), F.avg(f"ret{i}").alias("expected")).alias(f"s{i}")
        for i, s in enumerate(settings)
    ])
    out = sums.select("series", F.explode(F.array(*[F.col(f"s{i}") for i in range(len(settings))])).alias("s")).select("series", "s.*").where("n > 0")
    return out.select("series", "name", "n", "win_rate", "expected", (F.col("win_rate") * 100 * F.col("expected") * 1000).alias("score"))


def winsorised(df: DataFrame, x: str, low: float = 0.001, high: float = 0.999, name: str = "w") -> DataFrame:
    """Cut at the series' quantiles."""
    q = quantiles(df, x, ["series"], [low, high], "_q")
    return with_scalars(df, q, "left").withColumn(name, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_q")[0]), F.col("_q")[1]))).drop("_q")


def vol_scaled(df: DataFrame, y: str, k: int = 50, mode: str = "rolling", least: int = 10) -> DataFrame:
    """Adds sigma, scaled (y / sigma, winsorised at 0.1 and 99.9 %) and weight (1 / sigma). mode: rolling, garch and realized use the
    trailing standard deviation, constant the one of the whole series."""
    if mode == "constant":
        own = with_scalars(df, df.groupBy("series").agg(F.greatest(F.stddev_samp(y), F.lit(1e-6)).alias("sigma")))
    else:
        own = rolling_vol(df, y, k, least)
    return winsorised(own.withColumn("_s", F.col(y) / F.col("sigma")), "_s", name="scaled").drop("_s").withColumn("weight", 1 / F.col("sigma"))


def task_type(df: DataFrame, y: str) -> DataFrame:
    """(series, distinct_values, task): classification with at most 10 values that are whole or few against the rows, else regression."""
    out = df.groupBy("series").agg(F.count_distinct(y).alias("distinct_values"), F.count(y).alias("n"), F.bool_and(F.col(y) == F.round(F.col(y))).alias("whole"))
    few = (F.col("distinct_values") <= 10) & (F.col("whole") | (F.col("distinct_values") <= 0.1 * F.col("n")))
    return out.select("series", "distinct_values", F.when(few, "classification").otherwise("regression").alias("task"))


def session_mask(df: DataFrame, ts: str, schedule: DataFrame, holidays: DataFrame, driver: str, name: str = "open") -> DataFrame:
    """Whether the time lies in one of a driver's [start, end) minutes of that weekday (Monday is 0) and on no holiday. The calendar is a
    short table; each minute of a week is met at most once, so rows are not multiplied."""
    t = F.col(ts).cast("timestamp")
    slots = schedule.where(F.col("driver") == driver).select("weekday", F.explode(F.sequence("start_min", F.col("end_min") - 1)).alias("_m")).distinct()
    closed = holidays.where(F.col("driver") == driver).select(F.col("date").alias("_h")).distinct()
    own = df.withColumns({"_w": F.weekday(t), "_min": F.hour(t) * 60 + F.minute(t), "_date": F.to_date(t)})
    hit = own.join(sized(slots.withColumn("_in", F.lit(True))), (F.col("_w") == F.col("weekday")) & (F.col("_min") == F.col("_m")), "left")
    off = hit.join(sized(closed.withColumn("_off", F.lit(True))), F.col("_date") == F.col("_h"), "left")
    return off.withColumn(name, F.coalesce("_in", F.lit(False)) & F.col("_off").isNull()).select(*df.columns, name)


def driver_of(features: DataFrame, mapping: DataFrame, feature: str = "feature") -> DataFrame:
    """(feature, driver): by the longest substring of the name, letters in either case; null if there is none. Substrings of a name, of the
    lengths that the map holds (its catalogue of patterns bounds them), are looked up by an equality join, so neither side has to be small."""
    name = F.lower(feature)
    held = sorted(r["k"] for r in mapping.select(F.length(F.lower("substring")).alias("k")).where("k is not null").distinct().collect())
    cut = lambda k: F.when(F.length(name) >= k, F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda i: F.substring(name, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(*[cut(k) for k in held]) if held else F.array().cast("array<string>")
    each = features.select(feature, F.explode_outer(F.array_distinct(F.when(F.col(feature).isNotNull(), parts))).alias("_part"))
    met = each.join(mapping.select("driver", "substring", F.lower("substring").alias("_part")), "_part", "left")
    return met.groupBy(feature).agg(F.max_by("driver", F.struct(F.length("substring"), "substring")).alias("driver"))


def driver_mask(df: DataFrame, ts: str, flag: str | None, schedule: DataFrame, holidays: DataFrame, driver: str, name: str = "open") -> DataFrame:
    """The flag column where it has a value, else the schedule, else open if the driver has no schedule."""
    if schedule.where(F.col("driver") == driver).limit(1).count() == 0:
        own = df.withColumn("_scheduled", F.lit(True))
    else:
        own = session_mask(df, ts, schedule, holidays, driver, "_scheduled")
    return own.withColumn(name, F.coalesce(*([F.col(flag)] if flag else []), "_scheduled", F.lit(True))).drop("_scheduled")


def coverage_mask(df: DataFrame, columns: list[str], k: int = 120, least: int = 60) -> DataFrame:
    """covered_<column> for each column: whether enough of the last k rows have a value."""
    for c in columns:
        df = rolling_coverage(df, c, k, least, f"covered_{c}")
    return df
