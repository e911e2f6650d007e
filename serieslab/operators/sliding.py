"""Sliding windows over buckets of rows in a few array operations each, whatever the window's width.

A task takes a bucket of a series with its halo as arrays. Sums over windows are differences of running sums, centred in the bucket first;
least and greatest values come from running ones inside blocks of the window's width; the first row past a barrier from a table of
greatest values over powers of two; order statistics from a sorted window that moves by one row. All other columns pass through."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from serieslab.core import halo

#: Rows to a bucket at least; a bucket also has so many times the rows of its halo.
LEAST_ROWS, TIMES_HALO = 8_192, 8
Arrays = dict[str, np.ndarray]


def by_bucket(df: DataFrame, inputs: list[str], made: Callable[[Arrays], Arrays], outputs: dict[str, str], back: int = 0, ahead: int = 0, size: int | None = None) -> DataFrame:
    """Adds columns (name: type) made from the bucket's arrays of the inputs, as doubles, NaN where null, in the order of idx. NaN gives null."""
    size = size or max(LEAST_ROWS, TIMES_HALO * max(back, ahead))
    rest = [c for c in df.columns if c not in outputs]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        found = made({c: t[c].cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False) for c in inputs})
        out = t.select(rest)
        for name, kind in outputs.items():
            v = np.asarray(found[name], float)
            gone = np.isnan(v)
            out = out.append_column(name, pa.array(np.where(gone, 0, v), mask=gone).cast(types[kind]))
        return out.filter(t["_home"])

    kind = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{c}` {k}" for c, k in outputs.items()])
    return halo(df, back, ahead, size).groupBy("series", "_bucket").applyInArrow(run, kind)


def sums(v: np.ndarray, k: int) -> np.ndarray:
    """Sums over the last k values; fewer at the start."""
    run = np.concatenate([[0.0], np.cumsum(v)])
    at = np.arange(1, len(run))
    return run[1:] - run[np.maximum(at - k, 0)]


def greatest(v: np.ndarray, k: int) -> np.ndarray:
    """Greatest of the last k values, -inf standing for missing ones."""
    blocks = -(-(len(v) + k - 1) // k)
    padded = np.full(blocks * k, -np.inf)
    padded[k - 1 : k - 1 + len(v)] = v
    grid = padded.reshape(blocks, k)
    since = np.maximum.accumulate(grid, axis=1).ravel()
    until = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(until[: len(v)], since[k - 1 : k - 1 + len(v)])


def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(values less their mean, missing ones 0; whether there is one; the mean)."""
    real = np.isfinite(v)
    mean = float(v[real].mean()) if real.any() else 0.0
    return np.where(real, v - mean, 0.0), real, mean


def statistics(v: np.ndarray, k: int) -> Arrays:
    """n, mean, std (sample), sum, min and max over the last k rows; NaN where there are none. A constant window has a spread of exactly 0."""
    c, real, mean = centred(v)
    n = sums(real.astype(float), k)
    s, q = sums(c, k), sums(c * c, k)
    high, low = greatest(np.where(real, v, -np.inf), k), -greatest(np.where(real, -v, -np.inf), k)
    with np.errstate(invalid="ignore", divide="ignore"):
        some = np.where(n > 0, n, np.nan)
        spread = np.where(high > low, np.maximum(q - s * s / some, 0.0), 0.0)
        std = np.sqrt(spread / np.where(n > 1, n - 1, np.nan))
    return {"n": n, "mean": s / some + mean, "std": std, "sum": s + mean * some, "min": np.where(n > 0, low, np.nan), "max": np.where(n > 0, high, np.nan)}


def moments_of_pairs(x: np.ndarray, y: np.ndarray, k: int) -> Arrays:
    """n and centred sums xx, yy, xy of the last k rows that have both values; xx and yy of constants are exactly 0."""
    both = np.isfinite(x) & np.isfinite(y)
    x, y = np.where(both, x, np.nan), np.where(both, y, np.nan)
    (cx, *_), (cy, *_) = centred(x), centred(y)
    n = sums(both.astype(float), k)
    some = np.where(n > 0, n, np.nan)
    sx, sy = sums(cx, k), sums(cy, k)
    out = {"n": n, "xy": sums(cx * cy, k) - sx * sy / some}
    for name, v, c, s in (("xx", x, cx, sx), ("yy", y, cy, sy)):
        varies = greatest(np.where(both, v, -np.inf), k) > -greatest(np.where(both, -v, -np.inf), k)
        out[name] = np.where(varies, np.maximum(sums(c * c, k) - s * s / some, 0.0), 0.0)
    return out


def quantile(v: np.ndarray, k: int, q: float) -> np.ndarray:
    """The q quantile of the last k rows' values, interpolated between neighbours: the window stays sorted while it moves."""
    held: list[float] = []
    out = np.full(len(v), np.nan)
    values, real = v.tolist(), np.isfinite(v).tolist()
    for i, x in enumerate(values):
        if i >= k and real[i - k]:
            del held[bisect_left(held, values[i - k])]
        if real[i]:
            insort(held, x)
        if held:
            at = q * (len(held) - 1)
            low = int(at)
            out[i] = held[low] + (held[min(low + 1, len(held) - 1)] - held[low]) * (at - low)
    return out


def first_at_least(v: np.ndarray, barrier: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For each row the distance of the first row in [row + start, row + stop] whose value is at least the row's barrier; NaN if there is none.
    Missing values and barriers are never met."""
    span, levels = stop - start + 1, max(1, (stop - start + 1).bit_length())
    table = [np.concatenate([np.where(np.isfinite(v), v, -np.inf), np.full(stop + (2 << levels), -np.inf)])]
    for j in range(levels):
        last = table[-1]
        table.append(np.maximum(last, np.concatenate([last[1 << j :], np.full(1 << j, -np.inf)])))
    first = np.arange(len(v)) + start
    at = first.copy()
    for j in reversed(range(levels + 1)):
        at += np.where(table[j][at] >= barrier, 0, 1 << j)
        at = np.minimum(at, len(table[0]) - 1)
    away = at - first
    return np.where(away < span, away + start, np.nan)
