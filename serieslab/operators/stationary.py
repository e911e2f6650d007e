"""Fractional differences, variance stabilising, band-pass filters and decomposition."""

from __future__ import annotations

from math import pi, sin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from serieslab.core import halo, lengths, matched, ratio, trailing, windowed, with_scalars
from serieslab.operators.rolling import df_t


def fracdiff_weights(d: float, most: int = 1000, tolerance: float = 1e-5) -> list[float]:
    """Weights of (1 - L)^d, as many as it takes to cover all but `tolerance` of the sum of their sizes."""
    w = [1.0]
    for j in range(1, most + 1):
        w.append(w[-1] * (j - 1 - d) / j)
    sizes = np.cumsum(np.abs(w))
    return w[: int(np.searchsorted(sizes, (1 - tolerance) * sizes[-1])) + 1]


def taps(w: WindowSpec, x: str, weights: list[float], ahead: int = 0) -> Column:
    """Sum of weights[j] times the value j rows before a row that lies `ahead` rows on; null where one is missing."""
    total = F.lit(0.0)
    for j, c in enumerate(weights):
        total = total + F.lag(x, j - ahead).over(w) * F.lit(float(c))
    return total


def fracdiff(df: DataFrame, x: str, d: float, most: int = 1000, tolerance: float = 1e-5, name: str = "fd", size: int = 50_000) -> DataFrame:
    """Fractional difference of order d; the first rows, which lack a tap, are null. Up to 64 taps it is an expression, beyond that each
    bucket with its halo is convolved by NumPy."""
    weights = fracdiff_weights(d, most, tolerance)
    if len(weights) <= 64:
        return windowed(df, {name: lambda w: taps(w, x, weights)}, back=len(weights) - 1)
    kernel = np.array(weights)

    def convolve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        return g.assign(**{name: convolved(g[x].to_numpy(float), g["idx"].to_numpy(), kernel)})[g["_home"].to_numpy()]

    spread = halo(df, back=len(weights) - 1, size=size)
    kind = ", ".join(f"`{c}` {t}" for c, t in spread.dtypes) + f", `{name}` double"
    return spread.groupBy("series", "_bucket").applyInPandas(convolve, kind).withColumn(name, F.nanvl(name, F.lit(None))).drop("_bucket", "_home")


def convolved(v: np.ndarray, at: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums of kernel[j] times the value j rows before, for consecutive rows of a series; NaN where a tap is missing."""
    k = len(kernel)
    out = np.full(len(v), np.nan)
    if len(v) >= k:
        out[k - 1 :] = np.convolve(np.nan_to_num(v), kernel)[k - 1 : len(v)]
        missing = np.concatenate([[0], np.cumsum(np.isnan(v))])
        out[k - 1 :][missing[k:] > missing[:-k]] = np.nan
    out[at < k - 1] = np.nan
    return out


def fracdiff_grid(df: DataFrame, x: str, orders: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9), most: int = 1000, tolerance: float = 1e-5, size: int = 50_000) -> DataFrame:
    """(series, d, n, t, p, var_ratio): for each order the Dickey-Fuller t of the difference, its stepped p and its variance against that of x.

    One pass over haloed buckets serves all orders: each bucket gives counts, means and centred products, which are pooled by series. A
    constant series has no t; one that is shorter than the weights has n = 0 and p = 1."""
    kernels = {d: np.array(fracdiff_weights(d, most, tolerance)) for d in orders}
    spread = halo(df.select("series", "idx", F.col(x).cast("double").alias("_x")), back=max(map(len, kernels.values())), size=size)

    def centred(*columns: np.ndarray) -> list[float]:
        """n, the means, and the products of the centred columns."""
        m = np.column_stack(columns)
        m = m[~np.isnan(m).any(axis=1)]
        mean = m.mean(axis=0) if len(m) else np.zeros(len(columns))
        s = (m - mean).T @ (m - mean)
        return [float(len(m)), *mean, *s[np.triu_indices(len(columns))]]

    def products(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        v, at, home = g["_x"].to_numpy(float), g["idx"].to_numpy(), g["_home"].to_numpy(bool)
        rows = []
        for d, kernel in kernels.items():
            y = convolved(v, at, kernel)
            before = np.concatenate([[np.nan], y[:-1]])
            rows.append((g["series"].iat[0], d, *centred(v[home]), *centred(y[home]), *centred(before[home], (y - before)[home])))
        return pd.DataFrame(rows, columns=names)

    values = ["nx", "mx", "xx", "ny", "my", "yy", "n", "mb", "ms", "bb", "bs", "ss"]
    names = ["series", "d", *values]
    parts = spread.groupBy("series", "_bucket").applyInPandas(products, f"series {dict(df.dtypes)['series']}, d double, " + ", ".join(f"{c} double" for c in values))

    def pooled(n: str, a: str, b: str, s: str) -> Column:
        return F.sum(s) + F.sum(F.col(n) * F.col(a) * F.col(b)) - ratio(F.sum(F.col(n) * F.col(a)) * F.sum(F.col(n) * F.col(b)), F.sum(n))

    sums = parts.groupBy("series", "d").agg(
        F.sum("ny").cast("bigint").alias("n"), pooled("nx", "mx", "mx", "xx").alias("xx"), F.sum("nx").alias("nx"), pooled("ny", "my", "my", "yy").alias("yy"), F.sum("ny").alias("ny"),
        pooled("n", "mb", "mb", "bb").alias("bb"), pooled("n", "mb", "ms", "bs").alias("bs"), pooled("n", "ms", "ms", "ss").alias("ss"), F.sum("n").alias("m"), F.sum(F.col("n") * F.col("mb") ** 2).alias("level"),
    )
    bb = F.when(F.col("bb") > 1e-20 * F.col("level"), F.col("bb"))
    t = df_t(ratio(F.col("bs"), bb), bb, F.col("ss"), F.col("m"))
    made = sums.select("series", "d", "n", t.alias("t"), ratio(ratio(F.col("yy"), F.col("ny")), ratio(F.col("xx"), F.col("nx"))).alias("var_ratio"))
    return made.select("series", "d", "n", "t", F.when(F.col("n") < 50, 1.0).otherwise(stepped_p(F.col("t"))).alias("p"), "var_ratio")


def fracdiff_search(df: DataFrame, x: str, orders: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5), alpha: float = 0.05, most: int = 1000) -> DataFrame:
    """(series, d, found, p, var_ratio): the least order whose difference passes the test, else the one with a variance ratio nearest one."""
    grid = fracdiff_grid(df, x, orders, most)
    passed = F.col("p") <= alpha
    pick = F.struct((~passed).cast("int"), F.when(passed, F.col("d")).otherwise(F.coalesce(F.abs(F.col("var_ratio") - 1), F.lit(float("inf")))), F.col("d"))
    best = grid.groupBy("series").agg(F.min_by(F.struct("d", passed.alias("found"), "p", "var_ratio"), pick).alias("b"))
    return best.select("series", "b.*")


def stepped_p(t: Column) -> Column:
    """p as a step function of the t statistic, at the usual critical values."""
    return F.when(t <= -3.43, 0.01).when(t <= -2.86, 0.05).when(t <= -2.57, 0.10).otherwise(1.0)


def variance_stabilised(df: DataFrame, x: str, kind: str = "log", name: str = "vs") -> DataFrame:
    """log or square root of x, shifted by the size of the series' least value plus 1e-8 where that is not positive."""
    low = df.groupBy("series").agg(F.min(x).alias("_low"))
    shift = F.when(F.col("_low") <= 0, F.abs("_low") + 1e-8).otherwise(F.lit(1e-8))
    made = {"log": F.log, "sqrt": F.sqrt, "boxcox": F.log}[kind](F.col(x) + shift)
    return with_scalars(df, low).withColumn(name, made).drop("_low")


def baxter_king_weights(k: int, low: float, high: float) -> list[float]:
    """Symmetric band-pass weights for periods between high and low (high < low), which sum to zero."""
    if not high < low:
        raise ValueError("high has to be the shorter period")
    a, b = 2 * pi / low, 2 * pi / high
    half = [(b - a) / pi] + [(sin(b * j) - sin(a * j)) / (pi * j) for j in range(1, k + 1)]
    w = half[:0:-1] + half
    off = sum(w) / len(w)
    return [c - off for c in w]


def baxter_king(df: DataFrame, x: str, k: int = 12, low: float = 32, high: float = 6, causal: bool = True, name: str = "bk") -> DataFrame:
    """Band-pass filter over 2k + 1 rows; causal: the result of a row stands k rows later, so that it uses no later row."""
    w = baxter_king_weights(k, low, high)
    return windowed(df, {name: lambda s: taps(s, x, w, 0 if causal else k)}, back=2 * k, ahead=0 if causal else k)


def fill_borders(df: DataFrame, x: str, k: int, name: str) -> DataFrame:
    """The first and last k rows get the nearest valid value inside."""
    inside = (F.col("idx") >= k) & (F.col("idx") < F.col("n") - k) & F.col(x).isNotNull()
    sized = with_scalars(df, lengths(df))
    ends = sized.groupBy("series").agg(F.min_by(x, F.when(inside, F.col("idx"))).alias("_first"), F.max_by(x, F.when(inside, F.col("idx"))).alias("_last"))
    out = with_scalars(sized, ends)
    value = F.when(F.col("idx") < k, F.col("_first")).when(F.col("idx") >= F.col("n") - k, F.col("_last")).otherwise(F.col(x))
    return out.withColumn(name, value).drop("n", "_first", "_last")


def seasonal_decompose(df: DataFrame, x: str, period: int) -> DataFrame:
    """trend (trailing mean), seasonal (mean of what is left at the same place of the period) and resid."""
    t = windowed(df, {"trend": lambda w: F.avg(x).over(trailing(w, period))}, back=period - 1).withColumn("_place", F.col("idx") % period)
    means = t.groupBy("series", "_place").agg(F.avg(F.col(x) - F.col("trend")).alias("seasonal"))
    return t.transform(with_scalars, means, "inner", ["series", "_place"]).withColumn("resid", F.col(x) - F.col("trend") - F.col("seasonal")).drop("_place")


def spectral_features(df: DataFrame, x: str, block: int = 256) -> DataFrame:
    """(series, block, n, dominant, entropy, centroid) of the power spectrum of each whole block of rows: the frequency with the most power,
    the entropy of the shares of power, and the mean frequency by power. Blocks with missing values are left out."""

    def spectrum(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("idx")[x].to_numpy(float)
        cols = ["series", "block", "n", "dominant", "entropy", "centroid"]
        if len(v) < block or np.isnan(v).any():
            return pd.DataFrame(columns=cols)
        power, freq = np.abs(np.fft.rfft(v - v.mean())[1:]) ** 2, np.fft.rfftfreq(len(v))[1:]
        total = power.sum()
        p = power / total if total else power
        row = [g["series"].iat[0], int(g["_b"].iat[0]), len(v), float(freq[power.argmax()]), float(-(p * np.log(p + 1e-9)).sum()), float((freq * p).sum())]
        return pd.DataFrame([row], columns=cols)

    cut = df.select("series", "idx", x, F.floor(F.col("idx") / block).alias("_b"))
    return cut.groupBy("series", "_b").applyInPandas(spectrum, f"series {dict(df.dtypes)['series']}, block bigint, n bigint, dominant double, entropy double, centroid double")


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through points in ascending order, by a tridiagonal solve."""
    h, n = np.diff(x), len(x)
    slope = np.diff(y) / h
    right, upper = (6 * np.diff(slope)).tolist(), h[1:-1].tolist()
    middle = (2 * (h[:-1] + h[1:])).tolist()
    for i in range(1, n - 2):
        w = upper[i - 1] / middle[i - 1]
        middle[i] -= w * upper[i - 1]
        right[i] -= w * right[i - 1]
    bend = np.zeros(n)
    for i in range(n - 3, -1, -1):
        bend[i + 1] = (right[i] - (upper[i] * bend[i + 2] if i < n - 3 else 0.0)) / middle[i]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = at - x[k]
    return y[k] + t * (slope[k] - h[k] * (2 * bend[k] + bend[k + 1]) / 6) + t * t * bend[k] / 2 + t**3 * (bend[k + 1] - bend[k]) / (6 * h[k])


def turning_points(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the inner maxima and minima; of a flat stretch its middle."""
    edge = np.flatnonzero(np.diff(v)) + 1  # where the value changes
    if len(edge) < 2:
        return edge[:0], edge[:0]
    starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(v)]])
    level = v[starts]
    inner = (starts + stops - 1) // 2
    up = np.diff(level) > 0
    return inner[1:-1][up[:-1] & ~up[1:]], inner[1:-1][~up[:-1] & up[1:]]


def envelope(v: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A spline through extremes, the outer two of each side mirrored at the ends."""
    n = len(v)
    x = np.concatenate([-places[1::-1], places, 2 * (n - 1) - places[: -3 if len(places) > 2 else None : -1]]).astype(float)
    y = np.concatenate([v[places[1::-1]], v[places], v[places[: -3 if len(places) > 2 else None : -1]]])
    return natural_spline(x, y, np.arange(n, dtype=float))


def sift(v: np.ndarray, modes: int, rounds: int = 50, enough: float = 0.05) -> list[np.ndarray]:
    """Intrinsic modes of a short series, and what is left: the mean of the spline envelopes is taken off until that changes a mode by less
    than `enough` of its energy, or for `rounds` rounds."""
    out, rest = [], v.astype(float)
    for _ in range(modes):
        h, found = rest.copy(), False
        for _ in range(rounds):
            tops, lows = turning_points(h)
            if len(tops) < 2 or len(lows) < 2:
                break
            mean = (envelope(h, tops) + envelope(h, lows)) / 2
            size = float(h @ h)
            h, found = h - mean, True
            if float(mean @ mean) < enough * enough * size:
                break
        if not found:
            break
        out.append(h)
        rest = rest - h
    return [*out, rest]


def turning_points_of(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of the inner maxima and of the minima of each row of a matrix, as `turning_points` has them."""
    rows, n = v.shape
    first = np.ones((rows, n), bool)
    np.not_equal(v[:, 1:], v[:, :-1], out=first[:, 1:])
    starts = np.flatnonzero(first)
    row, level = starts // n, v.ravel()[starts]
    place = (starts + np.concatenate([starts[1:], [rows * n]]) - 1) // 2 - row * n
    up, inner = level[1:] > level[:-1], (row[2:] == row[:-2])
    top, low = inner & up[:-1] & ~up[1:], inner & ~up[:-1] & up[1:]
    return [(row[1:-1][t], place[1:-1][t]) for t in (top, low)]


def envelopes(v: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """`envelope` of each row of a matrix, from the (row, place) of its extremes in order, two at least in a row. The tridiagonal systems of all
    rows are solved side by side, shorter ones filled up by equations of zeros."""
    rows, n = v.shape
    count = np.bincount(row, minlength=rows)
    head = np.cumsum(count) - count
    every = np.arange(rows)
    x, y = np.zeros((count.max() + 4, rows)), np.zeros((count.max() + 4, rows))
    at = np.arange(len(row)) - head[row] + 2
    x[at, row], y[at, row] = place, v[row, place]
    for k in (0, 1):
        left, right = head + 1 - k, head + count - 1 - k
        x[k], y[k] = -place[left], v[every, place[left]]
        x[count + 2 + k, every], y[count + 2 + k, every] = 2 * (n - 1) - place[right], v[every, place[right]]
    inside = np.arange(len(x) - 1)[:, None] < (count + 3)[None, :]
    h = np.where(inside, np.diff(x, axis=0), 1.0)
    slope = np.where(inside, np.diff(y, axis=0) / h, 0.0)
    real = inside[1:]
    right, upper, middle = np.where(real, 6 * np.diff(slope, axis=0), 0.0), np.where(inside[2:], h[1:-1], 0.0), np.where(real, 2 * (h[:-1] + h[1:]), 1.0)
    for i in range(1, len(middle)):
        w = upper[i - 1] / middle[i - 1]
        middle[i] -= w * upper[i - 1]
        right[i] -= w * right[i - 1]
    bend = np.zeros(x.shape)
    bend[-2] = right[-1] / middle[-1]
    for i in range(len(middle) - 2, -1, -1):
        bend[i + 1] = (right[i] - upper[i] * bend[i + 2]) / middle[i]
    passed = np.zeros((rows, n), np.int64)
    passed[row, place] = 1
    k = np.cumsum(passed, axis=1) + 1 + every[:, None] * len(x)  # two knots lie before the first place
    of = lambda values: np.pad(values, ((0, len(x) - len(values)), (0, 0))).T.ravel().take(k)
    t = np.arange(n, dtype=float) - of(x)
    linear, cubic = slope - h * (2 * bend[:-1] + bend[1:]) / 6, np.diff(bend, axis=0) / (6 * h)
    return of(y) + t * (of(linear) + t * (of(bend / 2) + t * of(cubic)))


def last_modes(v: np.ndarray, modes: int, rounds: int = 50, enough: float = 0.05) -> list[list[float]]:
    """The last values of the modes that `sift` finds in each row of a matrix, all rows sifted side by side."""
    out: list[list[float]] = [[] for _ in range(len(v))]
    rest, going = v.astype(float), np.arange(len(v))
    for _ in range(modes):
        h, live, found = rest.copy(), going, np.zeros(len(v), bool)
        for _ in range(rounds):
            ends = turning_points_of(h[live])
            able = np.min([np.bincount(r, minlength=len(live)) for r, _ in ends], axis=0) >= 2
            renumbered = np.cumsum(able) - 1
            live = live[able]
            if not len(live):
                break
            own = h[live]
            mean = sum(envelopes(own, renumbered[r[able[r]]], p[able[r]]) for r, p in ends) / 2
            h[live], found[live] = own - mean, True
            live = live[(mean * mean).sum(axis=1) >= enough * enough * (own * own).sum(axis=1)]
            if not len(live):
                break
        going = np.flatnonzero(found)
        if not len(going):
            break
        for i in going:
            out[i].append(float(h[i, -1]))
        rest[going] -= h[going]
    return [m + [float(r)] for m, r in zip(out, rest[:, -1], strict=True)]


def anchors(df: DataFrame, window: int, step: int) -> DataFrame:
    """Adds `anchor`: a row for each window [anchor - window, anchor) that holds it; anchors are window, window + step, ..."""
    low = F.greatest(F.ceil((F.col("idx") + 1 - window) / step), F.lit(0))
    high = F.floor(F.col("idx") / step)
    return df.withColumn("_j", F.explode(F.sequence(low, high))).withColumn("anchor", F.col("_j") * step + window).drop("_j")


#: Rows of a series to a task of windows at least, and windows that are sifted side by side.
WINDOW_ROWS, SIDE_BY_SIDE = 20_000, 400


def rolling_modes(df: DataFrame, x: str, window: int = 500, step: int = 50, embargo: int = 0, modes: int = 10) -> DataFrame:
    """(series, idx, modes array): for rows [anchor + embargo, anchor + step) the last value of each mode of the `window` rows before the
    anchor. Windows are decomposed independently and hold at most `window` rows; those with missing values give nothing. A task takes the
    windows that start in a bucket of rows, from the bucket and the rows after it that these windows reach."""
    size = -(-max(WINDOW_ROWS, window) // step) * step
    kind = dict(df.dtypes)["series"]

    def last_values(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        v, at = t["_x"].combine_chunks().to_numpy(zero_copy_only=False), t["idx"][0].as_py()
        cut = np.lib.stride_tricks.sliding_window_view(v, window)[::step][: size // step] if len(v) >= window else np.empty((0, window))
        whole = np.flatnonzero(~np.isnan(cut).any(axis=1))
        made = [m for i in range(0, len(whole), SIDE_BY_SIDE) for m in last_modes(cut[whole[i : i + SIDE_BY_SIDE]], modes)]
        series = pa.array([t["series"][0].as_py()] * len(made), t.schema.field("series").type)
        return pa.table({"series": series, "anchor": pa.array(whole * step + at + window, pa.int64()), "modes": pa.array(made, pa.list_(pa.float64()))})

    spread = halo(df.select("series", "idx", F.col(x).cast("double").alias("_x")), ahead=window, size=size)
    found = spread.groupBy("series", "_bucket").applyInArrow(last_values, f"series {kind}, anchor bigint, modes array<double>")
    at = (F.col("idx") - window - F.pmod(F.col("idx") - window, F.lit(step))) + window
    rows = df.select("series", "idx", at.alias("anchor")).where((F.col("idx") >= window) & (F.col("idx") - F.col("anchor") >= embargo))
    return matched(rows, found, ["series", "anchor"]).select("series", "idx", "modes")
