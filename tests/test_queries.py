"""Every query without SQL runs over the smallest tables, and again with the same rows; what they rest on is compared with direct computations."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab import catalogue
from serieslab.operators import dependence, labels, metrics, registry, relations, rolling, sampling, selection, stationary, stats
from serieslab.plans import q_flagship
from serieslab.sources import files
from tests.test_series import column, frame

QUERIES = catalogue.queries()
#: Fits of trees or many resamples: run once.
LONG = {"embedded_select", "fold_metrics", "stability_select", "importance_rank", "select_features", "post_selection_check", "train_final", "load_model", "multi_target_sweep", "flagship", "ic_bootstrap", "garch_fit", "garch_rolling", "dcor_scores", "dcor_permutation"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(catalogue.oracle_sql())))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns)) and (rows or name == "garch_rolling")
    if name not in LONG:
        assert sorted(map(repr, rows)) == sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))


def wide(spark, values: np.ndarray, names: list[str], series: str = "a"):
    rows = [(series, i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(values)]
    return spark.createDataFrame(rows, "series string, idx long, " + ", ".join(f"{n} double" for n in names)).repartition(3)


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 5))
    v[:, 1] = v[:, 0] + 0.1 * v[:, 1]
    v[:, 2] = v[:, 0] - v[:, 3] + 0.05 * v[:, 2]
    return v


@pytest.mark.parametrize("size", [37, 50_000])
def test_pairwise_correlations(spark, mixed, size):
    v = mixed.copy() + 1000
    v[::7, 1], v[::5, 2], v[:, 4] = np.nan, np.nan, 7.3
    v[:291, 3] = np.nan
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(wide(spark, v, list("abcde")), list("abcde"), size=size).collect()}
    assert len(got) == 10
    for i, a in enumerate("abcde"):
        for j in range(i + 1, 5):
            both = ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
            want = np.corrcoef(v[both, i], v[both, j])[0, 1] if both.sum() > 10 and j < 4 else 0
            assert got[a, "abcde"[j]] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("together", [1, 2, 4096])
def test_information_of_pairs(spark, mixed, together):
    v = np.round(mixed, 1)
    v[::6, 0] = np.nan
    pairs = [("a", "b"), ("b", "c"), ("c", "a")]
    got = {(r["a"], r["b"]): r["nmi"] for r in dependence.nmi_pairs(wide(spark, v, list("abcde")), pairs, 8, together=together).collect()}
    for a, b in pairs:
        x, y = v[:, "abcde".index(a)], v[:, "abcde".index(b)]
        cut = lambda z: np.minimum(np.floor((z - np.nanmin(z)) / (np.nanmax(z) - np.nanmin(z)) * 8), 7)
        both = ~np.isnan(x) & ~np.isnan(y)
        h = lambda *z: -sum(p * math.log(p) for p in np.unique(np.column_stack(z), axis=0, return_counts=True)[1] / both.sum())
        i, j = cut(x)[both], cut(y)[both]
        assert got[a, b] == pytest.approx((h(i) + h(j) - h(i, j)) / max(h(i), h(j)))
    assert dependence.nmi_pairs(wide(spark, v, list("abcde")), []).count() == 0


@pytest.mark.parametrize("size", [210, 50_000])
def test_fractional_grid(spark, size):
    x = np.cumsum(np.random.default_rng(8).normal(size=600)) + 50
    got = {r["d"]: r for r in stationary.fracdiff_grid(frame(spark, x), "x", (0.3, 0.6), most=200, size=size).collect()}
    for d in (0.3, 0.6):
        w = np.array(stationary.fracdiff_weights(d, 200))
        y = np.convolve(x, w)[len(w) - 1 : len(x)]
        b, s = y[:-1], np.diff(y)
        slope, level = np.polyfit(b, s, 1)
        t = slope / math.sqrt(((s - slope * b - level) ** 2).sum() / (len(b) - 2) / ((b - b.mean()) ** 2).sum())
        assert (got[d]["n"], got[d]["t"], got[d]["var_ratio"]) == (len(y), pytest.approx(t, rel=1e-6), pytest.approx(y.var() / x.var()))
    best = stationary.fracdiff_search(frame(spark, x), "x", (0.3, 0.6), most=200).first()
    passed = [d for d in (0.3, 0.6) if got[d]["t"] <= -2.86]
    assert best["d"] == (passed[0] if passed else min((0.3, 0.6), key=lambda d: abs(got[d]["var_ratio"] - 1)))


@pytest.mark.parametrize("values", [[], [3.0], [3.0] * 80, [None] * 80])
def test_fractional_grid_of_little(spark, values):
    for r in stationary.fracdiff_grid(frame(spark, values), "x", (0.5,), most=20).collect():
        assert r["t"] is None and r["p"] == 1


def test_profile_holds_every_measure(spark):
    x = np.cumsum(np.random.default_rng(9).normal(size=1300)) + 90
    got = {r["measure"]: r["value"] for r in stats.feature_profile(frame(spark, x), "x").collect()}
    assert got["mean"] == pytest.approx(x.mean()) and got["autocorr_5"] == pytest.approx(np.corrcoef(x[5:], x[:-5])[0, 1])
    means = np.array([x[max(0, i - 49) : i + 1].mean() for i in range(len(x))])
    assert got["rolling_mean_50_mean"] == pytest.approx(means.mean()) and got["cycle_50_std"] == pytest.approx((x - means).std())
    assert got["stabilised_sqrt_mean"] == pytest.approx(np.sqrt(x + 1e-8).mean())
    power = [np.abs(np.fft.rfft(b - b.mean())[1:]) ** 2 for b in x[:1280].reshape(5, 256)]
    assert got["spectral_dominant"] == pytest.approx(np.mean([(p.argmax() + 1) / 256 for p in power]))
    assert {f"frac_diff_d{d}_{n}" for d in (0.1, 0.3, 0.5, 0.7, 0.9) for n in ("t", "p", "var_ratio")} <= set(got)


def test_variance_inflation_walk(spark, mixed):
    names = list("abcde")
    rows = {r["feature"]: r for r in selection.vif_select(wide(spark, mixed, names), names).collect()}
    live = list(range(5))
    while len(live) > 2:
        inverse = np.diag(np.linalg.inv(np.corrcoef(mixed[:, live].T)))
        if inverse.max() <= 5:
            break
        worst = int(inverse.argmax())
        r = rows[names[live.pop(worst)]]
        assert not r["kept"] and r["vif"] == pytest.approx(inverse.max(), rel=0.02)
    assert {n for n, r in rows.items() if r["kept"]} == {names[i] for i in live}


def test_redundant_features_go_by_score(spark, mixed):
    names = list("abcde")
    df = wide(spark, mixed, names)
    r = np.abs(np.corrcoef(mixed.T))
    kept = []
    for i in range(5):
        if all(r[i, j] < 0.9 for j in kept):
            kept.append(i)
    assert selection.corr_preprune(df, names) == [names[i] for i in kept]
    got = {x["feature"]: x for x in selection.mi_redundancy(df, names, {"c": 1.0}, 0.0).collect()}
    assert got["b"]["because"] == "correlation" and [n for n, x in got.items() if x["kept"]] == ["c"]
    clusters = {x["feature"]: x for x in selection.mi_clusters(df, names, {"b": 1.0}, 0.6).collect()}
    assert clusters["a"]["cluster"] == clusters["b"]["cluster"] and clusters["b"]["kept"] and not clusters["a"]["kept"]


def test_permutations_tell_noise_from_dependence(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(120, 3))
    v[:, 1] = v[:, 0] ** 2
    got = {r["feature"]: r for r in dependence.dcor_permutation(wide(spark, v, ["y", "p", "n"]), "y", ["p", "n"], 40).collect()}
    assert got["p"]["significant"] and got["p"]["p"] == pytest.approx(1 / 41) and got["n"]["p"] > 1 / 41


def test_split_is_a_function_of_the_key(spark):
    df = frame(spark, range(4000))
    split = column(sampling.random_split(df, ["idx"]), "split")
    assert split == column(sampling.random_split(df.repartition(5), ["idx"]), "split") and 0.17 < split.count("test") / 4000 < 0.23
    assert sampling.random_split(df.withColumn("idx", F.lit(None).cast("long")), ["idx"]).select("split").distinct().count() == 1


def test_cut_values_stay_missing(spark):
    v = np.array([[np.nan, 1.0, 1.0], [np.nan, 1.0, 1.0], [3.0, 4.0, 1.0], [1.0, np.nan, 1.0], [2.0, 2.0, 1.0]])
    df = wide(spark, v, ["y", "p", "s"])
    assert column(rolling.rolling_relationship(df, "y", "p", 2), "relationship")[:2] == [None, None]
    assert metrics.vol_adjusted_metrics(df, "y", "p", "s").first()["n"] == 2


def test_batch_of_columns_equals_single_tests(spark, mixed):
    v = np.cumsum(mixed, axis=0)
    df = wide(spark, v, list("abcde")).union(wide(spark, v[:150] + 1, list("abcde"), None))
    got = {(r["series"], r["feature"]): r for r in stats.adf_batch(df, ["a", "c"], 3).collect()}
    assert len(got) == 4
    for c in "ac":
        for r in stats.adf_test(df.select("series", "idx", c), c, 3).collect():
            assert got[r["series"], c]["t"] == pytest.approx(r["t"]) and got[r["series"], c]["n"] == r["n"]


def test_average_linkage(spark):
    """Clusters of features against a plain walk over all pairs of clusters."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1500, 3))
    v = np.column_stack([base[:, i % 3] + 0.15 * (i // 3) * rng.normal(size=1500) for i in range(9)])
    names = [f"c{i}" for i in range(9)]
    df = wide(spark, v, names)
    for threshold in (0.1, 0.3, 0.6):
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        nmi = {(r["a"], r["b"]): r["nmi"] for r in dependence.nmi_pairs(df, pairs, 16).collect()}
        far = lambda a, b: 1 - nmi[(a, b) if a < b else (b, a)] / max(nmi.values())
        groups = [[c] for c in names]
        while len(groups) > 1:
            d, i, j = min((np.mean([far(a, b) for a in groups[i] for b in groups[j]]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            if d > 1 - threshold:
                break
            groups[i] += groups.pop(j)
        got = {}
        for r in selection.mi_clusters(df, names, {}, threshold, 16).collect():
            got.setdefault(r["cluster"], set()).add(r["feature"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def test_driver_is_the_longest_substring(spark):
    features = spark.createDataFrame([("SPX_dxy_1",), ("xspx",), ("none",), ("",), (None,), ("xspx",)], "feature string")
    mapping = spark.createDataFrame([("spx", "a"), ("spx_d", "b"), ("DXY", "c")], "substring string, driver string")
    got = {r["feature"]: r["driver"] for r in labels.driver_of(features, mapping).collect()}
    assert got == {"SPX_dxy_1": "b", "xspx": "a", "none": None, "": None, None: None}
    long = spark.createDataFrame([("z" * 100_000 + "spx_d" + "y" * 50_000,)], "feature string")
    assert labels.driver_of(long, mapping).first()["driver"] == "b"
    assert {r["driver"] for r in labels.driver_of(features, mapping.limit(0)).collect()} == {None}


def test_object_store_is_split_and_shares_no_setting(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(40_000).selectExpr("id", "cast(id as string) AS t", "hash(id) AS h").repartition(2).write.option("parquet.block.size", 65_536).parquet(f"{root}/EURUSD")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    fine = files.scan_object_store(spark, root, ["id", "h"], "EURUSD", split_bytes=100_000)
    whole = files.scan_object_store(spark, f"{root}/EURUSD", ["id", "h"])
    assert fine.count() == 40_000 and fine.agg(F.sum("id")).first()[0] == 40_000 * 39_999 // 2 and fine.columns == ["id", "h"]
    assert fine.rdd.getNumPartitions() > whole.rdd.getNumPartitions() and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert fine.join(spark.range(10), "id").count() == 10


def test_files_of_a_deleted_model_go(spark, tmp_path):
    root = f"file://{tmp_path}"
    names = [("EURUSD", "007"), ("EURUSD", "a+b c%"), ("USDJPY", "007")]
    for kind in ("model", "meta"):
        spark.createDataFrame([(*n, 1.0) for n in names], "symbol string, model string, v double").write.partitionBy("symbol", "model").parquet(f"{root}/{kind}")
    found = lambda: sorted({(r["kind"], r["symbol"], r["model"]) for r in files.stored_files(spark, root).collect()})
    every = sorted((k, *n) for k in ("model", "meta") for n in names)
    assert found() == every and all(r["size"] > 0 for r in files.stored_files(spark, root).collect())
    assert files.delete_stored(spark, root, "EURUSD", "a+b c%") and not files.delete_stored(spark, root, "EURUSD", "a+b c%")
    assert found() == [e for e in every if e[1:] != names[1]] and not files.delete_stored(spark, root, "GBPUSD", "007")
    assert {r["symbol"]: r["n"] for r in registry.storage_stats(files.stored_files(spark, root)).collect()} == {"EURUSD": 2, "USDJPY": 2}


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_of_names_in_blocks(spark, block):
    names = [f"f{i}" for i in range(40)] + ["f3", None]
    got = sorted(tuple(r) for r in relations.feature_pairs(spark.createDataFrame([(n,) for n in names], "feature string"), block).collect())
    assert got == sorted((a, b) for a in names for b in names if a is not None and b is not None and a < b)


@pytest.fixture(scope="module")
def long_pairs(spark):
    """More rows than were once looked at; the feature follows the target in the first of them only."""
    rng = np.random.default_rng(17)
    x, y = rng.normal(size=(2, 20_600))
    x[:600] = 3 * y[:600]
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "series string, idx long, x double, y double")
    whole, last = ({r["feature"]: r["dcor2"] for r in dependence.distance_corr(df, "y", ["x"], most).collect()}["x"] for most in (None, 20_000))
    assert whole > 2 * last
    return df, whole


def test_scores_are_of_all_pairs(spark, long_pairs):
    df, whole = long_pairs
    assert dependence.dcor_scores(df, "y", ["x"]).first()["score"] == pytest.approx(whole, abs=1e-12)
    assert dependence.dcor_scores(df.limit(20), "y", ["x"]).count() == 0


def test_selection_goes_by_scores_of_all_pairs(spark, long_pairs):
    df, whole = long_pairs
    got = {(r["stage"], r["feature"]): r for r in selection.select_features(df, "y", ["x"], least=0.0, rounds=1, depth=1).collect()}
    assert got["dcor", "x"]["score"] == got["score", "x"]["score"] == pytest.approx(whole, abs=1e-12)


def test_stages_of_the_flagship_carry_no_other_columns(spark, sf_dir):
    assert set(q_flagship.features_of_events(spark, sf_dir).columns) == {"series", "idx", "x", "y_5", "y_10", *q_flagship.FEATURES}
