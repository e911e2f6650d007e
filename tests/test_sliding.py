"""Sliding kernels against direct windows, and the operators on them over buckets, partitions and gaps."""

from __future__ import annotations

import numpy as np
import pytest

from serieslab.operators import labels, rolling, sliding
from tests.test_series import column, frame


def series_with_gaps(n: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    v = 1e4 + rng.normal(size=n) * 0.1
    v[rng.random(n) < 0.2] = np.nan
    v[n // 3 : n // 3 + 9] = 1e4
    return v


@pytest.mark.parametrize("n", [1, 5, 333])
@pytest.mark.parametrize("k", [1, 2, 60])
def test_kernels(n, k):
    v, y = series_with_gaps(n), np.random.default_rng(1).normal(size=n)
    s, m, q = sliding.statistics(v, k), sliding.moments_of_pairs(v, y, k), sliding.quantile(v, k, 0.3)
    for i in range(n):
        w = slice(max(0, i - k + 1), i + 1)
        u, z = v[w][np.isfinite(v[w])], y[w][np.isfinite(v[w])]
        assert s["n"][i] == len(u)
        if len(u):
            assert [s[c][i] for c in ("mean", "sum", "min", "max")] == pytest.approx([u.mean(), u.sum(), u.min(), u.max()])
            assert q[i] == pytest.approx(np.quantile(u, 0.3)) and m["xy"][i] == pytest.approx(((u - u.mean()) * (z - z.mean())).sum(), abs=1e-8)
            assert len(u) < 2 or s["std"][i] == pytest.approx(u.std(ddof=1), abs=1e-8)
            assert (m["xx"][i] == 0) == (u.min() == u.max())
        else:
            assert all(np.isnan(s[c][i]) for c in ("mean", "std", "sum", "min", "max")) and np.isnan(q[i])


@pytest.mark.parametrize(("start", "stop"), [(0, 0), (1, 5), (5, 60), (3, 3)])
def test_first_touch(start, stop):
    v, rng = series_with_gaps(300, 2), np.random.default_rng(3)
    barrier = np.where(rng.random(300) < 0.1, np.nan, v + rng.normal(size=300) * 0.1)
    got = sliding.first_at_least(v, barrier, start, stop)
    for i in range(300):
        met = [j - i for j in range(i + start, min(i + stop, 299) + 1) if v[j] >= barrier[i]]
        assert got[i] == met[0] if met else np.isnan(got[i])


def test_buckets_and_other_columns_do_not_matter(spark):
    v = series_with_gaps(400, 4)
    df = frame(spark, [None if np.isnan(x) else x for x in v]).selectExpr("*", "timestamp_seconds(idx) AS ts", "cast(idx AS decimal(9,2)) AS d", "array(idx) AS a", "named_struct('k', idx) AS s")
    made = lambda v: {"z": rolling.zscore(v["x"], 30, 5), "d": v["x"] > 0}
    small, large = (sliding.by_bucket(df, ["x"], made, {"z": "double", "d": "boolean"}, back=29, size=n) for n in (29, 10_000))
    pairs = list(zip(column(small, "z"), column(large, "z"), strict=True))
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-6)) for a, b in pairs)
    first = small.orderBy("idx").first()
    assert set(small.columns) == set(df.columns) | {"z"} and first["a"] == [0] and first["s"]["k"] == 0 and dict(small.dtypes)["d"] == "boolean" and first["ts"].timestamp() == 0
    wide = rolling.rolling_quantile(df, "x", 1000)
    assert column(wide, "median")[-1] == pytest.approx(np.nanmedian(v))


def test_labels_do_not_depend_on_the_way(spark):
    rng = np.random.default_rng(6)
    p = np.exp(np.cumsum(rng.normal(0, 0.001, 500)))
    p[100], p[200] = np.nan, 0.0
    got = {r["idx"]: r for r in labels.triple_barrier(frame(spark, [None if np.isnan(x) else x for x in p]), "x", 0.002, 0.001, 40, 5).collect()}
    for i in range(500):
        if i + 45 >= 500 or np.isnan(p[i + 45]):
            assert i not in got
            continue
        hit = next(((j, 1 if p[i + j] >= p[i] * 1.002 else -1) for j in range(5, 41) if p[i + j] >= p[i] * 1.002 or p[i + j] <= p[i] * (1 - 0.001)), (40, 0))
        ret = None if not p[i] > 0 or np.isnan(p[i + hit[0]]) else p[i + hit[0]] / p[i] - 1
        assert (got[i]["periods"], got[i]["label"]) == hit and got[i]["ret"] == (ret if ret is None else pytest.approx(ret))
