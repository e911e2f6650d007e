"""Boosting against a direct NumPy version, in one task and by levels; folds, early stops, classes, odd rows, storage."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab.operators import boosting, model, selection
from serieslab.operators.sampling import cpcv_roles, cpcv_splits, fold_bits
from tests.test_queries import wide


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    x[:, 2] = np.round(x[:, 2], 1)
    return x, x[:, 0] ** 2 + np.sign(x[:, 1]) + 0.2 * rng.normal(size=300)


def table(spark, x, y, parts=3):
    return wide(spark, np.column_stack([x, y]), ["a", "b", "c", "y"]).repartition(parts)


def direct(x, y, classes, rounds, rate, depth, l2, bins):
    """Scores of all rows after boosting on all of them, by plain loops over features, cuts and leaves."""
    borders = []
    for v in x.T:
        s = np.sort(v)
        ends = [s[i] for i in range(len(s) - 1) if s[i] != s[i + 1] and np.searchsorted(s, s[i]) * bins // len(s) != (i + 1) * bins // len(s)]
        borders.append(ends)
    k = classes if classes > 2 else 1
    score = np.full((len(y), k), y.mean() if not classes else 0.0)
    for _ in range(rounds):
        if not classes:
            g, h = score - y[:, None], np.ones_like(score)
        elif classes == 2:
            p = 1 / (1 + np.exp(-score))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
            g, h = p - np.eye(k)[y.astype(int)], p * (1 - p)
        leaf = np.zeros(len(y), int)

        def gain(leaf, g=g, h=h):
            return sum((g[leaf == v].sum(axis=0) ** 2 / (h[leaf == v].sum(axis=0) + l2)).sum() for v in np.unique(leaf))

        for level in range(depth):
            found = [(gain(leaf + (x[:, f] > c) * 2**level), -f, -i) for f in range(x.shape[1]) for i, c in enumerate(borders[f])]
            _, f, i = max(found, key=lambda t: (round(t[0], 9), *t[1:]))
            leaf = leaf + (x[:, -f] > borders[-f][-i]) * 2**level
        for v in np.unique(leaf):
            score[leaf == v] -= rate * g[leaf == v].sum(axis=0) / (h[leaf == v].sum(axis=0) + l2)
    return score


@pytest.mark.parametrize("classes", [0, 2, 3])
@pytest.mark.parametrize("local", [0, 1 << 20])
def test_as_a_direct_version(spark, data, classes, local):
    x, y = data
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    more = {"rounds": 4, "rate": 0.3, "depth": 2, "l2": 1.5, "subsample": 1.0, "bins": 8}
    (m,) = boosting.boost(table(spark, x, y), "y", ["a", "b", "c"], "classification" if classes else "regression", local_cells=local, **more)
    want = direct(x, y, classes, 4, 0.3, 2, 1.5, 8)
    got = m.scores(np.stack([boosting.to_bins(v, b) for v, b in zip(x.T, m.borders, strict=True)]))
    assert got == pytest.approx(want, abs=1e-6)
    said = {r["idx"]: r["prediction"] for r in boosting.predicted(table(spark, x, y), m).collect()}
    label = want[:, 0] if not classes else (want[:, 0] > 0) if classes == 2 else want.argmax(axis=1)
    assert [said[i] for i in range(300)] == pytest.approx(label.astype(float), abs=1e-6)


def test_ways_of_growing_and_partitions_agree(spark, data):
    x, y = data
    folds = [(F.col("idx") < 150, (F.col("idx") >= 150) & (F.col("idx") < 200)), (F.col("idx") < 200, F.col("idx") >= 200), (F.lit(False), F.lit(True))]
    more = {"rounds": 45, "rate": 0.2, "depth": 3, "patience": 8, "l2": 3.0}
    one = boosting.boost(table(spark, x, y, 1), "y", ["a", "b", "c"], folds=folds, **more)
    other = boosting.boost(table(spark, x, y, 7), "y", ["a", "b", "c"], folds=folds, local_cells=0, **more)
    trees = lambda m: [(t.features, t.cuts, t.values.tolist(), t.weights.tolist()) for t in m.trees]
    assert [trees(m) for m in one] == [trees(m) for m in other] and [m.losses for m in one] == [m.losses for m in other]
    assert one[0].trees and one[1].trees and not one[2].trees
    for a, b in zip(one[:2], other[:2], strict=True):
        assert a.metrics["check"] == pytest.approx(b.metrics["check"]) and a.metrics["check"]["mse"] == pytest.approx(min(a.losses), abs=1e-4)


def test_early_stop_and_rows_that_check_are_not_learnt(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 3))
    (noise,) = boosting.boost(table(spark, x, rng.normal(size=400)), "y", ["a", "b", "c"], folds=[(F.col("idx") < 300, F.col("idx") >= 300)], patience=10, rounds=200)
    assert len(noise.losses) < 100 and len(noise.trees) == int(np.argmin(noise.losses))
    odd = table(spark, x, np.where(np.arange(400) < 300, x[:, 0], x[:, 0] + 1000))
    (m,) = boosting.boost(odd, "y", ["a", "b", "c"], folds=[(F.col("idx") < 300, F.lit(False))], rounds=30, rate=0.3)
    assert boosting.predicted(odd, m).agg(F.max("prediction")).first()[0] < 10
    late = table(spark, np.where(np.arange(400)[:, None] < 200, np.nan, x), x[:, 0])
    _, split = model.train_final(late, "y", ["a"], rounds=2, depth=2)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 160, "test": 40}


def test_importances_find_the_signal_and_models_survive_storage(spark, data, tmp_path):
    x, y = data
    (m,) = boosting.boost(table(spark, x, y), "y", ["a", "b", "c"], rounds=60, rate=0.1, depth=4)
    own = m.importances()
    assert sum(own.values()) == pytest.approx(100) and own["c"] < min(own["a"], own["b"]) / 4
    model.save_model(spark, m, str(tmp_path / "m"), spark.createDataFrame([(1,)], "n int"))
    again, meta = model.load_model(spark, str(tmp_path / "m"))
    assert again.to_json() == m.to_json() and meta.first()["n"] == 1


def test_odd_tables(spark):
    few = wide(spark, np.array([[1.0, 2.0], [np.nan, 1.0], [1.0, np.nan]]), ["a", "y"])
    (m,) = boosting.boost(few, "y", ["a"], rounds=3)
    assert m.base == [2.0] and boosting.predicted(few, m).where("prediction is null").count() == 1
    (none,) = boosting.boost(few.limit(0), "y", ["a"], rounds=3)
    assert none.trees == [] and none.importances() == {"a": 0.0}
    (same,) = boosting.boost(few, "y", ["a"], "classification", rounds=3)
    assert same.labels == [2.0] and {r["prediction"] for r in boosting.predicted(few, same).collect()} == {2.0, None}


def test_folds_are_bits_not_copies(spark):
    df = wide(spark, np.arange(700.0).reshape(350, 2), ["a", "y"])
    bits = fold_bits(df, cpcv_roles(6, 2, 5, 9))
    assert bits.count() == 350
    want = {(r["idx"], r["role"], r["combo"]) for r in cpcv_splits(df, 6, 2, 5, 9).collect()}
    got = {(r["idx"], n, i) for r in bits.collect() for n in ("train", "test", "purged") for i in range(15) if r[f"{n}_bits"] >> i & 1}
    assert got == want
    models = selection.fold_models(df, "y", ["a"], cpcv=(6, 2), purge=5, embargo=9, least_train=50, rounds=3)
    assert len(models) == 15
    for i, m in enumerate(models):
        assert m.metrics["train"]["n"] == sum(f == i and role == "train" for _, role, f in want) and m.metrics["check"]["n"] == sum(f == i and role == "test" for _, role, f in want)


@pytest.mark.parametrize("regression", [True, False])
def test_level_sums_are_those_of_all_rows_and_count_the_smaller_side(regression, monkeypatch):
    rng = np.random.default_rng(11)
    blocks = []
    for n in (400, 900):
        x = rng.integers(0, 128, (4, n)).astype(np.uint8)
        y = x[0] / 64 + rng.normal(size=n) if regression else (x[0] + rng.integers(0, 60, n) > 90).astype(float)
        blocks.append(boosting.Block(x, y, rng.integers(-(2**62), 2**62, n), rng.random((1, n)) < 0.8, np.zeros((1, n), bool)))
    g = boosting.Growth(0, boosting.Settings(rounds=3), 1, regression, 2.0**36, 8.0 if regression else 1.0, [0.0])
    before, seen = None, []
    counted = g.counted
    monkeypatch.setattr(g, "counted", lambda x, *rest: (seen.append(x.shape[1]), counted(x, *rest))[1])
    while not g.done:
        seen.clear()
        sums = g.level_sums(blocks, before if g.level else None)
        learnt = sum(len(g.part(b).node) for b in blocks)
        assert sum(seen) == learnt if not g.level else 2 * sum(seen) <= learnt
        assert np.array_equal(sums, sum(g.histograms(b) for b in blocks))
        before = sums
        g.advance(*g.best(sums))
    assert len(g.trees) == 3


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_equal_rows_are_grown_as_one_group(classes):
    """The trees of groups are those of their rows, whose draws and folds differ."""
    rng = np.random.default_rng(23)
    size = rng.integers(1, 9, 500)
    x, key = rng.integers(0, 128, (4, 500)).astype(np.uint8), rng.integers(-(2**62), 2**62, size.sum())
    y = x[0] / 64 + rng.normal(size=500) if not classes else ((x[0] + rng.integers(0, 60, 500)) % (2 * classes) // 2 % classes).astype(float)
    train, check = rng.random((2, size.sum())) < 0.5
    row = np.repeat(np.arange(500), size)
    starts = np.cumsum(np.append(0, size[:-1]))

    def trees(blocks):
        g, sums = boosting.grown(boosting.Growth(0, boosting.Settings(rounds=12, patience=5), classes if classes > 2 else 1, not classes, 2.0**34, 8.0 if not classes else 1.0, [0.0] * (classes if classes > 2 else 1)), blocks)
        assert len(g.trees) > 1
        return [(t.features, t.cuts, t.values.tolist(), t.weights.tolist()) for t in g.trees], g.losses, sums

    whole = boosting.Block(x, y, key, {0: train}, {0: check}, starts=starts)
    want = trees([boosting.Block(x[:, row], y[row], key, train[None], check[None])])
    half = int(starts[250])
    halves = [boosting.Block(x[:, :250], y[:250], key[:half], {0: train[:half]}, {0: check[:half]}, starts=starts[:250]), boosting.Block(x[:, 250:], y[250:], key[half:], {0: train[half:]}, {0: check[half:]}, starts=starts[250:] - half)]
    for blocks in ([whole], halves, [boosting.joined([boosting.of_fold(b, 0) for b in halves], 0)]):
        got = trees(blocks)
        assert got[:2] == want[:2] and got[2] == pytest.approx(want[2])


def test_copies_of_rows_grow_in_tasks(spark, data, monkeypatch):
    """A task's bound is of groups of equal rows, so copies do not send a fit to a job for each level."""
    x, y = np.round(data[0]), np.round(data[1])
    order = np.random.default_rng(1).permutation(6000)
    many = table(spark, np.tile(x, (20, 1))[order], np.tile(y, 20)[order], 5)
    folds = [(F.col("idx") < 3000, (F.col("idx") >= 3000) & (F.col("idx") < 4000)), (F.col("idx") < 4000, F.col("idx") >= 4000)]
    more = {"rounds": 6, "depth": 3, "rate": 0.3, "folds": folds}
    levels = boosting.boost(many, "y", ["a", "b", "c"], local_cells=0, **more)
    monkeypatch.setattr(boosting, "_grow_by_levels", None)
    tasks = boosting.boost(many, "y", ["a", "b", "c"], local_cells=6000, **more)
    grown = lambda ms: [(m.losses, [(t.features, t.cuts, t.values.tolist(), t.weights.tolist()) for t in m.trees]) for m in ms]
    assert grown(tasks) == grown(levels) and all(m.trees for m in tasks)


def test_more_folds_than_a_column_of_flags_holds(spark):
    df = wide(spark, np.arange(400.0).reshape(200, 2), ["a", "y"])
    models = boosting.boost(df, "y", ["a"], folds=[((F.col("idx") >= i), F.col("idx") < i) for i in range(70)], rounds=1, depth=1)
    assert [(m.metrics["train"]["n"], m.metrics.get("check", {"n": 0})["n"]) for m in models] == [(200 - i, i) for i in range(70)]


def test_targets_of_a_sweep_are_selected_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    monkeypatch.setattr(selection, "select_features", lambda df, y, columns: (both.wait(), df.select("a"))[1])
    found = selection.multi_target_sweep(wide(spark, np.ones((2, 3)), ["a", "y", "z"]), ["y", "z"], ["a"])
    assert sorted(r["target"] for r in found.collect()) == ["y", "y", "z", "z"]
