"""Operators against direct computations, whatever the partitioning and the size of buckets; edge cases."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab import core
from serieslab.operators import bootstrap, columns, dependence, labels, metrics, rolling, sampling, selection, stationary, stats, volatility


def frame(spark, values, series="a", parts=3):
    rows = [(series, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, idx long, x double").repartition(parts)


def column(df, name):
    return [r[name] for r in df.orderBy("series", "idx").collect()]


@pytest.fixture(scope="module")
def walk():
    return np.exp(np.cumsum(np.random.default_rng(42).normal(0.0001, 0.01, 700)))


def test_row_index_is_dense_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("series"), F.xxhash64("id").alias("o"), "id").repartition(7)
    got = {r["id"]: r["idx"] for r in core.with_row_index(df, ["series"], ["o", "id"]).collect()}
    rows = sorted((r["series"], r["o"], r["id"]) for r in df.collect())
    place: dict = {}
    for s, _, i in rows:
        assert got[i] == place.get(s, 0)
        place[s] = place.get(s, 0) + 1


@pytest.mark.parametrize("size", [60, 97, 50_000])
def test_windows_do_not_depend_on_buckets(spark, walk, size):
    df = frame(spark, walk)
    w = core.windowed(df, {"m": lambda w: F.avg("x").over(core.trailing(w, 50)), "l": lambda w: F.lead("x", 40).over(w)}, back=49, ahead=40, size=size)
    assert np.allclose(column(w, "m"), [walk[max(0, i - 49) : i + 1].mean() for i in range(len(walk))])
    assert column(w, "l")[:5] == [pytest.approx(v) for v in walk[40:45]] and column(w, "l")[-1] is None
    r = core.running(df, {"s": F.col("x")}, size)
    assert np.allclose(column(r, "s"), np.cumsum(walk))


def test_fill_across_buckets(spark):
    df = frame(spark, [None, 1, None, None, None, None, 2, None])
    assert column(core.filled(df, ["x"], size=2), "x") == [None, 1, 1, 1, 1, 1, 2, 2]
    assert column(core.filled(df, ["x"], forward=False, size=2), "x") == [1, 1, 2, 2, 2, 2, 2, None]


def test_fractional_difference_limits(spark, walk):
    df = frame(spark, walk)
    assert np.allclose(column(stationary.fracdiff(df, "x", 0.0), "fd"), walk)
    got = column(stationary.fracdiff(df, "x", 1.0), "fd")
    assert got[0] is None and np.allclose(got[1:], np.diff(walk))
    long = stationary.fracdiff_weights(0.5, 200)
    got = column(stationary.fracdiff(df, "x", 0.5, 200, size=230), "fd")
    want = np.convolve(walk, long)[len(long) - 1 : len(walk)]
    assert got[len(long) - 2] is None and np.allclose(got[len(long) - 1 :], want)


def test_band_pass_weights_and_causality(spark, walk):
    w = stationary.baxter_king_weights(12, 32, 6)
    assert abs(sum(w)) < 1e-12 and w == w[::-1]
    with pytest.raises(ValueError):
        stationary.baxter_king_weights(12, 6, 32)
    changed = walk.copy()
    changed[400:] += 5
    a, b = (column(stationary.baxter_king(frame(spark, v), "x"), "bk") for v in (walk, changed))
    assert a[:400] == b[:400] and a[401] != b[401]


def test_garch_scan_equals_loop(spark, walk):
    df = volatility.log_returns(frame(spark, walk), "x")
    fits = spark.createDataFrame([("a", 1e-6, 0.1, 0.85)], "series string, omega double, alpha double, beta double")
    r = np.diff(np.log(walk))
    h, want = r.var(), []
    for v in r:
        want.append(h)
        h = 1e-6 + 0.1 * v * v + 0.85 * h
    assert np.allclose(column(volatility.conditional_variance(df, fits, 53), "h"), want, rtol=1e-12)


def test_garch_fit_recovers(spark):
    rng = np.random.default_rng(3)
    h, r = 1e-4, []
    for _ in range(4000):
        r.append(math.sqrt(h) * rng.normal())
        h = 5e-6 + 0.1 * r[-1] ** 2 + 0.85 * h
    _, a, b, _ = volatility.fit_garch(np.array(r))
    assert abs(a - 0.1) < 0.05 and abs(b - 0.85) < 0.08


def garch_paths(n=3, length=900):
    rng, out = np.random.default_rng(5), {}
    for k in range(n):
        h, r = 1e-4, []
        for _ in range(length - 1):
            r.append(math.sqrt(h) * rng.normal())
            h = 5e-6 + (0.05 + 0.05 * k) * r[-1] ** 2 + 0.8 * h
        out[f"s{k}" if k else None] = np.exp(np.concatenate([[0], np.cumsum(r)]))
    return out


def direct_loglik(r, w, a, b):
    h, out = r.var(), 0.0
    for x in r:
        out -= 0.5 * (math.log(2 * math.pi * h) + x * x / h)
        h = w + a * x * x + b * h
    return out


@pytest.mark.parametrize("local", [0, 10_000])
def test_garch_fits_are_stationary_points(spark, local):
    paths = garch_paths()
    df = frame(spark, paths[None], None)
    for k in ("s1", "s2"):
        df = df.unionByName(frame(spark, paths[k], k))
    got = {r["series"]: r for r in volatility.garch_fit(df, "x", None, local, size=101).collect()}
    assert set(got) == set(paths)
    for k, x in paths.items():
        r, at = np.diff(np.log(x)), np.array([got[k][c] for c in ("omega", "alpha", "beta")])
        assert got[k]["loglik"] == pytest.approx(direct_loglik(r, *at), abs=1e-5) and got[k]["n"] == 899
        for step in np.diag(at * 1e-2 + [0, 1e-3, 1e-3]):
            for sign in (1, -1):
                moved = at + sign * step
                assert min(moved) < 0 or moved[1] + moved[2] >= 0.9999 or direct_loglik(r, *moved) <= got[k]["loglik"] + 1e-4
        assert at == pytest.approx(volatility.fit_garch(r)[:3], rel=1e-3, abs=1e-7)


def test_garch_sums_are_slopes():
    z, theta = np.random.default_rng(2).normal(size=300) ** 2, np.array([0.1, 0.12, 0.8])
    value = lambda t: volatility.likelihood_sums(z, t, np.array([1.0, 0, 0, 0]))
    for i in range(3):
        d = np.eye(3)[i] * 1e-6
        assert value(theta)[1 + i] == pytest.approx((value(theta + d)[0] - value(theta - d)[0]) / 2e-6, rel=1e-5)
    made = volatility.after(volatility.after(np.array([1.0, 0, 0, 0]), volatility.state_map(z[:100], theta), 100, 0.8), volatility.state_map(z[100:], theta), 200, 0.8)
    assert made == pytest.approx(volatility.after(np.array([1.0, 0, 0, 0]), volatility.state_map(z, theta), 300, 0.8))


def test_a_missing_price_skips_itself_only(spark):
    x = garch_paths(1, 1300)[None]
    holes = [None if i in (500, 1150) else v for i, v in enumerate(x)]
    got = {r["idx"]: r for r in volatility.garch_rolling(frame(spark, holes), "x").collect()}
    assert sorted(got) == list(range(1000, 1300))
    want = volatility.fit_garch(np.diff(np.log(np.delete(x[:1000], 500))))
    assert [got[1001][c] for c in ("omega", "alpha", "beta")] == pytest.approx(want[:3])
    assert volatility.garch_rolling(frame(spark, [None] * 1200), "x").count() == 0


def test_windows_are_fitted_side_by_side_like_alone(monkeypatch):
    rng = np.random.default_rng(3)
    paths = [np.diff(np.log(x[:n])) for x, n in zip(garch_paths(3, 700).values(), (700, 633, 95), strict=True)] + [rng.normal(size=60), np.zeros(70), np.exp(rng.normal(size=300) * 3)]
    got = volatility.fit_windows(paths)
    for one, r in zip(got, paths, strict=True):
        assert one == pytest.approx(volatility.fit_garch(r), rel=1e-6, abs=1e-9)
    z, theta = rng.normal(size=(301, 2)) ** 2, np.array([[0.1, 0.12, 0.8], [0.5, 0.3, 1e-9]])
    there = np.array([[1.0, 1.0]] * 200 + [[1.0, 0.0]] * 101)
    sums = volatility.likelihood_sums_of_columns(z, there, theta)
    for i, n in enumerate((301, 200)):
        assert sums[i] == pytest.approx(volatility.likelihood_sums(z[:n, i], theta[i], np.array([1.0, 0, 0, 0])), rel=1e-9)


@pytest.mark.parametrize(("window", "step", "embargo", "side"), [(120, 50, 7, 2), (60, 80, 0, 3), (100, 3, 0, 4)])
def test_rolling_garch_has_every_window(spark, monkeypatch, window, step, embargo, side):
    monkeypatch.setattr(volatility, "SIDE_BY_SIDE", side)
    x = {s: [float(u) for u in v] for s, v in garch_paths(2, 403).items()}
    x[None][130], x["s1"][7], x["s1"][8] = None, 0.0, -1.0
    df = spark.createDataFrame([(s, i, v) for s, path in x.items() for i, v in enumerate(path)], "series string, idx long, x double").repartition(5)
    got = {(r["series"], r["idx"]): r for r in volatility.garch_rolling(df, "x", window, step, embargo).collect()}
    anchors = [a for a in range(window, 404, step)]
    assert sorted(i for s, i in got if s) == sorted(i for s, i in got if not s) == [i for a in anchors for i in range(a + embargo, min(a + step, 403))]
    for s, path in x.items():
        for a in anchors[:: max(1, len(anchors) // 4)]:
            if a + embargo < 403:
                own = np.array([v for v in path[a - window : a] if v is not None and v > 0])
                assert [got[s, a + embargo][c] for c in ("omega", "alpha", "beta")] == pytest.approx(volatility.fit_garch(np.diff(np.log(own)))[:3], rel=1e-4, abs=1e-7)


def test_rolling_garch_rows_go_to_few_tasks(spark, monkeypatch):
    """A row was copied once for each of the ten windows that hold it; now once for its bucket, and again for the one that reaches over it."""
    from pyspark.sql import Observation

    seen, halo = Observation(), volatility.halo
    monkeypatch.setattr(volatility, "halo", lambda *a, **k: halo(*a, **k).observe(seen, F.count(F.lit(1)).alias("n")))
    x = np.exp(np.cumsum(np.random.default_rng(7).normal(0, 0.01, 14_000)))
    assert volatility.garch_rolling(frame(spark, [float(v) for v in x]), "x").count() == 13_000
    assert seen.get["n"] <= 15_000


def test_rolling_garch_query_takes_the_whole_series(spark, tmp_path):
    import datetime as dt

    from serieslab.plans import q_metrics

    x = np.exp(np.cumsum(np.random.default_rng(7).normal(0, 0.01, 1350)))
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 1, "a", float(v)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["idx"]: r for r in q_metrics.QUERIES["garch_rolling"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1000, 1350))
    for a in (1000, 1100, 1200, 1300):
        want = volatility.fit_garch(np.diff(np.log(x[a - 1000 : a])))
        for i in range(a, min(a + 100, 1350)):
            assert [got[i][c] for c in ("omega", "alpha", "beta", "persistence")] == pytest.approx([*want[:3], want[1] + want[2]], abs=1e-4)


def direct_dcor2(x, y):
    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    return (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())


@pytest.mark.parametrize(("local", "block", "blocks"), [(10_000, 50_000, 1_000), (50, 37, 1_000), (50, 7, 5)])
def test_distance_correlation(spark, monkeypatch, local, block, blocks):
    monkeypatch.setattr(dependence, "BLOCK_PAIRS", block)
    monkeypatch.setattr(dependence, "MOST_BLOCKS", blocks)
    rng = np.random.default_rng(1)
    x = rng.normal(size=600) * 1e-5 + 3
    y = (x - 3) ** 2 * 1e9 + rng.normal(size=600) * 0.1
    t = np.round(y)
    rows = [("a" if i % 2 else None, i // 2, float(u), float(v), 7.3, float(w) if i % 5 else None) for i, (u, v, w) in enumerate(zip(x, y, t, strict=True))]
    df = spark.createDataFrame(rows, "series string, idx long, x double, y double, c double, t double").repartition(4)
    got = {r["feature"]: r for r in dependence.distance_corr(df, "y", ["x", "c", "t"], None, local=local).collect()}
    some = np.arange(600) % 5 != 0
    assert got["x"]["dcor2"] == pytest.approx(direct_dcor2(x, y), abs=1e-9) and got["x"]["n"] == 600
    assert got["t"]["dcor2"] == pytest.approx(direct_dcor2(t[some], y[some]), abs=1e-9) and got["t"]["n"] == 480 and got["c"]["dcor2"] == 0
    last = {r["feature"]: r["dcor2"] for r in dependence.distance_corr(df, "y", ["x"], 101).collect()}
    order = sorted(range(600), key=lambda i: (i // 2, i % 2))[-101:]
    assert last["x"] == pytest.approx(direct_dcor2(x[order], y[order]), abs=1e-9)
    series = {(r["series"]): r["dcor2"] for r in dependence.distance_corr(df, "y", ["x"], 50, ["series"]).collect()}
    assert series == pytest.approx({None: direct_dcor2(x[::2][-50:], y[::2][-50:]), "a": direct_dcor2(x[1::2][-50:], y[1::2][-50:])}, abs=1e-9)


def test_distance_correlation_of_all_pairs_needs_no_order(spark, monkeypatch):
    monkeypatch.setattr(dependence, "BLOCK_PAIRS", 40)
    monkeypatch.setattr(dependence, "COLUMNS_TOGETHER", 2)
    rng = np.random.default_rng(9)
    y = np.where(rng.random(900) < 0.6, 5.0, np.round(rng.normal(size=900), 2))  # one value takes most rows
    many, few = rng.normal(size=900) + y, rng.integers(0, 3, 900) * 1.5 + (y > 5)
    rare = np.where(rng.random(900) < 0.1, y**2, np.nan)
    df = spark.createDataFrame([(*map(float, r), None if math.isnan(r[3]) else float(r[3])) for r in zip(y, many, few, rare, strict=True)], "y double, many double, few double, nans double, nulls double").repartition(5)
    got = {r["feature"]: r for r in dependence.distance_corr(df, "y", ["many", "few", "nans", "nulls", "y"], None, local=200).collect()}
    some = ~np.isnan(rare)
    want = {"many": direct_dcor2(many, y), "few": direct_dcor2(few, y), "nans": direct_dcor2(rare[some], y[some]), "nulls": direct_dcor2(rare[some], y[some]), "y": 1.0}
    assert {k: r["dcor2"] for k, r in got.items()} == pytest.approx(want, abs=1e-12)
    assert {k: r["n"] for k, r in got.items()} == {"many": 900, "few": 900, "nans": some.sum(), "nulls": some.sum(), "y": 900}


def test_a_frequent_value_is_a_block_dealt_out_in_shares():
    cuts = dependence._cuts([1.0, 2.0, 2.0, 2.0, 7.0])
    block, shares = dependence._block(np.array([0.0, 1.0, 1.5, 2.0, 2.5, 7.0, 8.0]), cuts)
    assert block.tolist() == [0, 0, 2, 3, 4, 4, 6] and shares.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_distance_sums_of_many_pairs():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=5_000), np.round(rng.normal(size=5_000), 1)
    dx, dy = (np.abs(v[:, None] - v[None, :]) for v in (x, y))
    a, b = dx.sum(axis=1), dy.sum(axis=1)
    want = [5_000, (dx * dy).sum(), a @ b, a @ a, b @ b, a.sum(), b.sum(), (dx**2).sum(), (dy**2).sum()]
    assert dependence.distance_sums(x, y) == pytest.approx(want, rel=1e-9)


def test_permutations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, float(a), float(b)) for s in ("a", "b", None) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "series string, idx long, x double, y double")
    one, three, five = ([tuple(r) for r in dependence.dcor_permutation(df.repartition(n), "y", ["x"], 20, most=100).collect()] for n in (1, 3, 5))
    assert one == three == five


def test_nmi_of_itself_and_constant(spark, walk):
    df = frame(spark, walk).withColumn("y", F.col("x")).withColumn("c", F.lit(1.0))
    got = {(r["a"], r["b"]): r["nmi"] for r in dependence.nmi_pairs(df, [("x", "y"), ("x", "c")]).collect()}
    assert got["x", "y"] == pytest.approx(1) and got["x", "c"] == 0


def test_vif_of_two_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = x + rng.normal(size=400)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, y, strict=True)], "x double, y double")
    r = np.corrcoef(x, y)[0, 1]
    got = selection.vif_select(df, ["x", "y"]).collect()
    assert all(g["vif"] == pytest.approx(1 / (1 - r * r), rel=0.02) and g["kept"] for g in got)


def test_purged_folds_keep_their_distance(spark):
    df = frame(spark, range(200))
    for r in sampling.purged_kfold(df, 4, 5, 10).groupBy("fold").agg(F.collect_list(F.struct("idx", "role")).alias("r")).collect():
        test = {x["idx"] for x in r["r"] if x["role"] == "test"}
        train = {x["idx"] for x in r["r"] if x["role"] == "train"}
        assert len(test) == 50 and not train & {i for t in test for i in range(t - 5, t + 16)}
    assert sampling.cpcv_splits(df, 6, 2, 5, 5).select("combo").distinct().count() == 15


def test_triple_barrier_against_loop(spark, walk):
    got = {r["idx"]: (r["label"], r["periods"]) for r in labels.triple_barrier(frame(spark, walk), "x", 0.02, 0.01, 30, 5).collect()}
    assert len(got) == len(walk) - 35
    for t, (label, periods) in got.items():
        hit = next(((1 if walk[k] >= walk[t] * 1.02 else -1, k - t) for k in range(t + 5, t + 31) if walk[k] >= walk[t] * 1.02 or walk[k] <= walk[t] * 0.99), (0, 30))
        assert (label, periods) == hit


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 120), rng.integers(0, 9, 120) / 9
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, s, strict=True)], "series string, y int, s double")
    pairs = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
    assert metrics.auc_roc(df, "y", "s").first()["auc"] == pytest.approx(np.mean(pairs))


def test_adf_agrees_with_least_squares(spark, walk):
    got = stats.adf_test(frame(spark, walk), "x", 2, trend=False).first()
    d = np.diff(walk)
    rows = range(2, len(d))
    a = np.array([[walk[i], d[i - 1], d[i - 2], 1] for i in rows])
    y = d[2:]
    beta, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    se = math.sqrt(float(rss[0]) / (len(y) - 4) * np.linalg.inv(a.T @ a)[0, 0])
    assert got["t"] == pytest.approx(beta[0] / se, rel=1e-6) and got["n"] == len(y)


@pytest.mark.parametrize("values", [[], [None] * 5, [1.0], [2.0] * 30, [1.0, None, 3.0]])
def test_edge_series(spark, values):
    df = frame(spark, values)
    n = len(values)
    assert rolling.rolling_stats(df, "x", 5).count() == n
    assert rolling.rolling_zscore(df, "x", 5, 2).count() == n
    assert rolling.rolling_df_tstat(df, "x", 6, 4).count() == n
    assert stationary.fracdiff(df, "x", 0.5, 200).count() == n
    assert labels.triple_barrier(df, "x", 0.1, 0.1, 3, 1).count() == sum(v is not None for v in values[4:])
    assert rolling.average_ranks(df, "x").count() == n
    assert columns.fill_both_ways(df, ["x"]).count() == n
    for f in (stats.df_test, stats.moments, stats.hist_entropy, stats.variance_ratio, stats.trend_strength):
        assert f(df, "x").count() <= 1
    if n and all(v == values[0] and v is not None for v in values):
        assert set(column(rolling.rolling_zscore(df, "x", 5, 2), "z")) == {None}


def test_infinities_become_null(spark):
    df = spark.createDataFrame([("a", 0, float("nan")), ("a", 1, float("inf")), ("a", 2, 1.0)], "series string, idx long, x double")
    assert column(columns.ensure_finite(df, ["x"], 7.0), "x") == [7.0, 7.0, 1.0]
    assert columns.drop_incomplete_rows(df, ["x"]).count() == 1


def test_modes_add_up(walk):
    assert np.allclose(sum(stationary.sift(walk[:500], 10)), walk[:500])


def test_splines_and_modes_of_two_tones():
    x, at = np.sort(np.random.default_rng(9).choice(200, 12, replace=False)).astype(float), np.arange(200.0)
    y, h = np.sin(x / 9), np.diff(x)
    full = np.zeros((12, 12))
    full[0, 0] = full[-1, -1] = 1
    for i in range(1, 11):
        full[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
    bend = np.linalg.solve(full, np.concatenate([[0], 6 * np.diff(np.diff(y) / h), [0]]))
    for v, t in zip(stationary.natural_spline(x, y, at), at, strict=True):
        k = min(max(int(np.searchsorted(x, t, "right")) - 1, 0), 10)
        a, b = (x[k + 1] - t) / h[k], (t - x[k]) / h[k]
        assert v == pytest.approx(a * y[k] + b * y[k + 1] + ((a**3 - a) * bend[k] + (b**3 - b) * bend[k + 1]) * h[k] ** 2 / 6, abs=1e-7)
    t = np.arange(500)
    fast, slow = np.sin(2 * np.pi * t / 12), 2 * np.sin(2 * np.pi * t / 90)
    found = stationary.sift(fast + slow, 10)
    assert np.allclose(sum(found), fast + slow) and np.corrcoef(found[0], fast)[0, 1] > 0.98 and np.corrcoef(found[1], slow)[0, 1] > 0.98
    assert len(stationary.sift(np.ones(50), 10)) == 1 and len(stationary.sift(t.astype(float), 10)) == 1
    assert [list(x) for x in stationary.turning_points(np.array([0, 1, 1, 1, 0, 2, 1.0]))] == [[2, 5], [4]]


@pytest.mark.parametrize("width", [7, 16, None])
def test_bootstrap_ranks_within_each_round(spark, width):
    rng = np.random.default_rng(4)
    y, p = np.round(rng.normal(size=210), 1), np.round(rng.normal(size=210), 1)
    y[rng.permutation(210)[:80]], p[40:110] = 0.3, -0.2  # values of many rows, which small tasks share
    df = spark.createDataFrame([("a", i, float(u), float(v)) for i, (u, v) in enumerate(zip(y, p, strict=True))] + [("b", i, float(i), float(i)) for i in range(30)], "series string, idx long, y double, p double").repartition(3)
    got = {r["series"]: r for r in metrics.ic_bootstrap(df, "y", "p", 25, width=width).collect()}
    keys = spark.range(25).select(F.lit("a").alias("series"), F.col("id").cast("int").alias("round")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    starts = {(r["round"], r["k"]): r["s"] for r in keys.withColumn("s", F.pmod(F.xxhash64("series", "round", "k", F.lit(42)), F.lit(210).cast("long"))).collect()}

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    ics = []
    for r in range(25):
        at = np.concatenate([(starts[r, k] + np.arange(20)) % 210 for k in range(10)])
        ics.append(np.corrcoef(ranks(y[at]), ranks(p[at]))[0, 1])
    a = got["a"]
    assert a["n_rounds"] == 25 and [a["mean"], a["std"], a["low"], a["high"]] == pytest.approx([np.mean(ics), np.std(ics), np.percentile(ics, 2.5), np.percentile(ics, 97.5)])
    assert a["t"] == pytest.approx(np.mean(ics) / (np.std(ics) / 5))
    b = got["b"]
    assert (b["n_rounds"], b["mean"], b["std"], b["t"], b["p_value"]) == (0, pytest.approx(1), 0, 0, 1)


def test_bootstrap_of_no_rows_nulls_and_constants(spark):
    kind = "series string, idx long, y double, p double"
    assert metrics.ic_bootstrap(spark.createDataFrame([], kind), "y", "p", 5).count() == 0
    rows = [(None, i, None if i % 5 == 0 else float(i % 7), float(i % 11)) for i in range(400)] + [("c", i, 2.0, float(i)) for i in range(250)]
    got = {r["series"]: r for r in metrics.ic_bootstrap(spark.createDataFrame(rows, kind).repartition(3), "y", "p", 5, width=50).collect()}
    assert got[None]["n_rounds"] == 5 and got[None]["std"] > 0
    assert (got["c"]["n_rounds"], got["c"]["mean"], got["c"]["p_value"]) == (0, 0, 1)


def test_counts_and_ranks_in_rounds():
    m = bootstrap.times_in_rounds(np.array([0, 2, 1]), np.array([3, 4, 4]), np.array([0, 0, 2]), 4, 3)
    assert m.T.tolist() == [[1, 1, 2, 1], [0, 0, 0, 0], [0, 1, 1, 1]]
    twice = bootstrap.double_ranks(np.array([5.0, 1, 5, 3]), m, np.array([10, 0, 0]))
    assert (twice[:, 0] / 2).tolist() == [10 + 4, 10 + 1, 10 + 4, 10 + 2]


@pytest.mark.parametrize("values", [[0.0] * 60, [2.0] * 60, [0.0, 1.0] * 30])
def test_zeros_and_constants_do_not_fail(spark, values):
    df = frame(spark, values).withColumn("y", F.lit(1.0))
    assert labels.triple_barrier(df, "x", 0.1, 0.1, 3, 1).count() == len(values) - 4
    flat = len(set(values)) == 1
    assert all(r["r"] == 0 for r in stats.autocorr(df, "x", [1, 2]).collect()) == flat
    assert stats.correlation_matrix(df, ["x", "y"]).first()["r"] == 0
    assert set(column(rolling.rolling_corr(df, "x", "y", 5, 3), "corr")) == {None}
    assert dependence.pearson_prefilter(df, "y", ["x"]).count() == 0
    assert metrics.spearman_ic(df, "x", "y").first()["ic"] is None
    path = df.withColumnRenamed("x", "r").withColumn("h", F.lit(0.0))
    fits = spark.createDataFrame([("a", 0.1, 0.5, 0.5, 1.0)], "series string, omega double, alpha double, beta double, persistence double")
    assert volatility.residual_stats(path).count() == 1 and volatility.vol_forecast(path, fits).where("vol is not null").count() == 0 and volatility.vol_diagnostics(path, fits).count() == 1
    assert stationary.fracdiff_grid(df, "x", (0.5,)).count() == 1 and stats.adf_test(df, "x").count() <= 1
    assert labels.winsorised(df, "x").count() == len(values)


def test_lags_follow_each_series_and_buckets_do_not_matter(spark, walk, monkeypatch):
    alone, longer = frame(spark, walk[:150], "s"), frame(spark, np.concatenate([walk, walk]), "l")
    one = stats.adf_test(alone, "x").first()
    both = {r["series"]: r for r in stats.adf_test(alone.union(longer), "x").collect()}
    assert both["s"] == one and one["lags"] == int(12 * 1.5**0.25) and both["l"]["lags"] == int(12 * 14**0.25)
    gaps = frame(spark, [None if i % 5 == 0 else float(v) for i, v in enumerate(walk[:60])])
    kept = np.array([v for i, v in enumerate(walk[:60]) if i % 5])
    assert np.allclose(column(volatility.log_returns(gaps, "x"), "r"), np.diff(np.log(kept)))
    assert np.allclose(column(volatility.log_returns(gaps, "x", 10), "r"), np.diff(np.log(kept[-10:])))
    assert column(volatility.log_returns(gaps, "x", 10), "idx") == list(range(9))


def test_quantiles_are_exact(spark, walk):
    df = frame(spark, [*walk, None, *walk[:50]])
    got = core.quantiles(df, "x", ["series"], [0.0, 0.013, 0.5, 1.0]).first()["q"]
    assert np.allclose(got, np.quantile([*walk, *walk[:50]], [0.0, 0.013, 0.5, 1.0]))


def test_backward_fill_takes_a_step_a_row(spark):
    """A backward fill may not sum up each row's whole rest of the bucket anew."""
    rows = spark.range(12).select(F.lit("a").alias("series"), F.col("id").alias("idx"), F.when(F.col("id") % 5 == 3, F.col("id").cast("double")).alias("v"))
    out = core.filled(rows, ["v"], forward=False, size=4)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r["v"] for r in out.orderBy("idx").collect()] == [3.0] * 4 + [8.0] * 5 + [None] * 3


def test_forecasts_leave_the_long_series_spread(spark, sf_dir):
    """The one row of means is no reason to send the whole series to one task."""
    from serieslab.plans.frames import forecasts

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert len(forecasts(spark, sf_dir).inputFiles()) > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_volatility_of_prices_with_zeros_is_that_of_the_sql(spark, tmp_path):
    """A price of zero gives infinite returns and so NaN, as in SQL; other series keep their numbers, a missing price ends its series' path."""
    from serieslab import catalogue
    from tests.against_sql import same

    rng = np.random.default_rng(1)
    rows = [(i, i, i % 7, "abcd"[i % 4], float(0 if i in (40, 44, 81, 200) else rng.exponential(50) + 1) if i != 83 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double")
    df.select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("conditional_variance", "garch_loglik", "vol_diagnostics", "vol_forecast", "vol_autocorr"):
        same(spark, str(tmp_path), catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_windows_sifted_side_by_side_have_the_modes_of_each():
    rng = np.random.default_rng(3)
    flat = np.stack([rng.integers(1, 51, 300).astype(float), np.cumsum(rng.normal(size=300)), np.ones(300), np.arange(300.0), np.sin(np.arange(300) / 9), rng.integers(0, 2, 300).astype(float)])
    for got, v in zip(stationary.last_modes(flat, 10), flat, strict=True):
        assert np.allclose(got, [m[-1] for m in stationary.sift(v, 10)])


def test_rounds_of_a_task_are_those_of_blocks_and_write_no_rows_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, 1200).astype(float)
    rows = [(s, i, float(v), float(v + w)) for s in ("a", None) for i, (v, w) in enumerate(zip(x, rng.integers(0, 30, 1200), strict=True))]
    df = spark.createDataFrame(rows, "series string, idx long, y double, p double").repartition(3)
    written = []
    monkeypatch.setattr(bootstrap, "materialise", lambda d: (written.append(d.columns), core.materialise(d))[1])
    whole = sorted(map(repr, metrics.ic_bootstrap(df, "y", "p", 60).select("series", "n_rounds", *[F.round(c, 9) for c in ("mean", "std", "low", "high")]).collect()))
    assert not any("m" in c for c in written)
    assert whole == sorted(map(repr, metrics.ic_bootstrap(df, "y", "p", 60, width=100).select("series", "n_rounds", *[F.round(c, 9) for c in ("mean", "std", "low", "high")]).collect()))


def test_adf_holds_the_lags_of_some_rows_at_a_time(spark, walk, monkeypatch):
    whole = stats.adf_test(frame(spark, walk), "x", 7).first()
    monkeypatch.setattr(stats, "LAGGED_ROWS", 64)
    part = stats.adf_test(frame(spark, walk), "x", 7).first()
    assert (whole["n"], whole["lags"]) == (part["n"], part["lags"]) and math.isclose(whole["t"], part["t"], rel_tol=1e-6)


def test_variance_of_returns_has_the_same_digits_for_all_partitions(spark):
    rng = np.random.default_rng(21)
    v = [*(rng.normal(size=3000) * np.exp(rng.normal(size=3000) * 3) + 5), None]
    rows = [("a", i, None if x is None else float(x)) for i, x in enumerate(v)] + [("b", i, x) for i, x in enumerate([1.0, float("inf"), 2.0])] + [(None, 0, 4.0)]
    df = spark.createDataFrame(rows, "series string, idx long, r double")
    seen = [{r["series"]: r["v"] for r in volatility.variance_of_returns(df.repartition(n)).collect()} for n in (1, 3, 7, 16)]
    mean = sum(map(Fraction, v[:-1])) / 3000
    want = float(sum((Fraction(x) - mean) ** 2 for x in v[:-1]) / 3000)
    assert {s["a"] for s in seen} == {seen[0]["a"]} and math.isclose(seen[0]["a"], want, rel_tol=4e-16) and math.isnan(seen[0]["b"]) and seen[0][None] == 0
    fits = spark.createDataFrame([(s, 0.5, 0.1, 0.8) for s in ("a", None)], "series string, omega double, alpha double, beta double")
    paths = [sorted(map(repr, volatility.conditional_variance(df.where("series = 'a' or series is null").repartition(n), fits).collect())) for n in (1, 3, 7)]
    assert paths[0] == paths[1] == paths[2]
