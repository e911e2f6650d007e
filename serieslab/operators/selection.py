"""Feature selection: matrices come from one Spark pass each, the greedy walks over features run on small matrices."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.operators.boosting import Ensemble, boost
from serieslab.operators.dependence import correlation, dcor_scores, gram, nmi_pairs
from serieslab.operators.sampling import cpcv_roles, expanding_roles, fold_bits, has_bit


def score_filter(scores: DataFrame, least: float = 0.5, k: int = 80, percentile: float = 0.0) -> DataFrame:
    """Scores of at least `least`, the k highest, of these the ones not below the given percentile's place (index int(n p), ascending)."""
    top = scores.where(F.col("score") >= least).orderBy(F.desc("score"), "feature").limit(k)
    if percentile <= 0:
        return top
    values = sorted(r["score"] for r in top.select("score").collect())  # at most k
    return top.where(F.col("score") >= values[min(int(len(values) * percentile), len(values) - 1)]) if values else top


def vif_select(df: DataFrame, columns: list[str], threshold: float = 5.0) -> DataFrame:
    """(feature, vif, kept, step): drops the feature with the largest variance inflation while that is over the threshold and more than two
    are left. Constants are dropped first; rows with a null are not used; under five complete rows all are kept."""
    spark = df.sparkSession
    n, _, s = gram(df, columns)
    names = list(columns)
    out: list[tuple] = []
    kind = "feature string, vif double, kept boolean, step int"
    if n < 5 or len(names) < 2:
        return spark.createDataFrame([(c, None, True, 0) for c in names], kind)
    flat = [c for c, v in zip(names, np.diag(s), strict=True) if v <= 0]
    out += [(c, None, False, 0) for c in flat]
    keep = [i for i, c in enumerate(names) if c not in flat]
    d = np.sqrt(np.diag(s)[keep])
    r = s[np.ix_(keep, keep)] / np.outer(d, d) * n / (n - 1) + 1e-6 * np.eye(len(keep))
    live, step = list(range(len(keep))), 0
    while True:
        sub = r[np.ix_(live, live)]
        values, vectors = np.linalg.eigh(sub)
        vif = np.diag((vectors / np.clip(values, 1e-10, None)) @ vectors.T)
        if len(live) <= 2 or vif.max() <= threshold:
            break
        step += 1
        worst = int(vif.argmax())
        out.append((names[keep[live[worst]]], float(vif[worst]), False, step))
        live.pop(worst)
    out += [(names[keep[i]], float(v), True, step + 1) for i, v in zip(live, vif, strict=True)]
    return spark.createDataFrame(out, kind)


def corr_preprune(df: DataFrame, columns: list[str], threshold: float = 0.9) -> list[str]:
    """The columns, in order, of which none before has a correlation of the threshold or more."""
    r, kept = np.abs(correlation(df, columns)), []
    for i in range(len(columns)):
        if all(r[i, j] < threshold for j in kept):
            kept.append(i)
    return [columns[i] for i in kept]


def mi_redundancy(df: DataFrame, columns: list[str], scores: dict[str, float], threshold: float = 0.1, bins: int = 32, prune: float = 0.9) -> DataFrame:
    """(feature, kept, because): after corr_preprune, of each pair with that much mutual information the lower-scored goes."""
    left = corr_preprune(df, columns, prune)
    gone = {c: "correlation" for c in columns if c not in left}
    pairs = [(a, b) for i, a in enumerate(left) for b in left[i + 1 :]]
    found = {(r["a"], r["b"]): r["nmi"] for r in nmi_pairs(df, pairs, bins).collect()} if pairs else {}
    for a, b in pairs:
        if a not in gone and b not in gone and found.get((a, b), 0) >= threshold:
            loser = b if scores.get(a, 0) >= scores.get(b, 0) else a
            gone[loser] = f"mutual information with {a if loser == b else b}"
    return df.sparkSession.createDataFrame([(c, c not in gone, gone.get(c)) for c in columns], "feature string, kept boolean, because string")


def mi_clusters(df: DataFrame, columns: list[str], scores: dict[str, float], threshold: float = 0.3, bins: int = 32, most: int = 400) -> DataFrame:
    """(feature, cluster, kept): average-linkage clusters of 1 - information, cut at 1 - threshold; the best-scored of each is kept."""
    if len(columns) > most:
        raise ValueError(f"at most {most} features")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    at = {c: i for i, c in enumerate(columns)}
    d = np.ones((len(columns), len(columns)))
    rows = nmi_pairs(df, pairs, bins).collect() if pairs else []
    top = max([r["nmi"] for r in rows], default=0) or 1.0
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = d[at[r["b"]], at[r["a"]]] = 1 - r["nmi"] / top
    groups = [[i] for i in range(len(columns))]
    d[np.tril_indices(len(columns))] = np.inf  # only i < j are looked at
    while len(groups) > 1:
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        if d[i, j] > 1 - threshold:
            break
        own, other = len(groups[i]), len(groups[j])
        whole = np.minimum(d, d.T)
        mean = (own * whole[i] + other * whole[j]) / (own + other)  # average linkage to the merged cluster
        d[:i, i], d[i, i + 1 :] = mean[:i], mean[i + 1 :]
        d = np.delete(np.delete(d, j, 0), j, 1)
        groups[i] += groups.pop(j)
    out = []
    for k, g in enumerate(groups):
        keep = max(g, key=lambda i: (scores.get(columns[i], 0.0), -i))
        out += [(columns[i], k, i == keep) for i in g]
    return df.sparkSession.createDataFrame(out, "feature string, cluster int, kept boolean")


def importance_threshold(importances: DataFrame, rule: str | float = "median") -> float:
    """median or pXX of the positive importances, knee (farthest from the chord of the sorted curve), or a number."""
    if not isinstance(rule, str):
        return float(rule)
    positive = importances.where("importance > 0")
    if rule == "knee":
        v = np.array(sorted((r["importance"] for r in positive.select("importance").collect()), reverse=True))  # one value a feature
        if len(v) < 3:
            return float(v.min(initial=0.0))
        x = np.linspace(0, 1, len(v))
        y = (v - v[-1]) / ((v[0] - v[-1]) or 1)
        return float(v[int(np.argmax(1 - x - y))])
    q = 0.5 if rule == "median" else float(rule[1:]) / 100
    return positive.agg(F.percentile("importance", q)).first()[0] or 0.0


def importances_of(spark: SparkSession, model: Ensemble) -> DataFrame:
    return spark.createDataFrame(list(model.importances().items()), "feature string, importance double")


def fold_models(df: DataFrame, y: str, columns: list[str], task: str = "regression", folds: int = 5, least_train: int = 200, cpcv: tuple[int, int] | None = None, purge: int = 50, embargo: int = 100, **fit) -> list[Ensemble]:
    """An ensemble for each combinatorial (cpcv: groups and how many to leave out) or else expanding fold with enough rows; each fold's test
    rows end its boosting. Without such folds one ensemble learns from all rows. All folds grow in the same passes, and rows are not copied:
    they carry the folds as bits."""
    roles = cpcv_roles(*cpcv, purge, embargo) if cpcv else expanding_roles(folds, least_train)
    rows = fold_bits(df, roles)
    found = boost(rows, y, columns, task, [(has_bit("train_bits", i), has_bit("test_bits", i)) for i in range(len(roles))], **fit)
    enough = lambda m: m.metrics.get("train", {}).get("n", 0) >= max(10, least_train) and m.metrics.get("check", {}).get("n", 0) >= max(5, least_train // 5)
    return [m for m in found if enough(m)] or boost(df, y, columns, task, **fit)


def fold_metrics(spark: SparkSession, models: list[Ensemble]) -> DataFrame:
    """(fold, part, metric, value) of ensembles: errors or class metrics of the rows learnt from and the rows that check, and the number of trees."""
    rows = [(i, part, name, float(v)) for i, m in enumerate(models) for part, values in m.metrics.items() for name, v in values.items()]
    rows += [(i, "train", "trees", float(len(m.trees))) for i, m in enumerate(models)]
    return spark.createDataFrame(rows, "fold int, part string, metric string, value double")


def mean_importances(spark: SparkSession, models: list[Ensemble]) -> DataFrame:
    each = [m.importances() for m in models]
    return spark.createDataFrame([(c, float(np.mean([e[c] for e in each]))) for c in models[0].columns], "feature string, importance double")


def embedded_select(df: DataFrame, y: str, columns: list[str], task: str = "regression", rule: str | float = "median", k: int | None = None, **fit) -> DataFrame:
    """(feature, importance, kept): importances averaged over the folds of `fold_models`, kept from the threshold on."""
    spark = df.sparkSession
    mean = mean_importances(spark, fold_models(df, y, columns, task, **fit))
    cut = importance_threshold(mean, rule)
    top = [r["feature"] for r in mean.where(F.col("importance") >= cut).orderBy(F.desc("importance"), "feature").limit(k or len(columns)).collect()]
    return mean.withColumn("kept", F.col("feature").isin(top))


def stability_select(df: DataFrame, y: str, columns: list[str], share: float = 0.65, **fit) -> DataFrame:
    """(feature, share, kept): features whose importance is at least the median in that share of the folds."""
    spark, hits = df.sparkSession, dict.fromkeys(columns, 0)
    models = fold_models(df, y, columns, **fit)
    for m in models:
        own = m.importances()
        cut = np.median([v for v in own.values() if v > 0] or [0.0])
        for c, v in own.items():
            hits[c] += v > 0 and v >= cut
    return spark.createDataFrame([(c, float(n / len(models)), bool(n / len(models) >= share)) for c, n in hits.items()], "feature string, share double, kept boolean")


def mrmr(relevance: dict[str, float], redundancy: dict[tuple[str, str], float], k: int = 30) -> list[str]:
    """Features by relevance less mean redundancy with those taken before."""
    pair = lambda a, b: redundancy.get((a, b), redundancy.get((b, a), 0.0))
    out: list[str] = []
    while len(out) < min(k, len(relevance)):
        left = [c for c in relevance if c not in out]
        out.append(max(left, key=lambda c: (relevance[c] - (sum(pair(c, o) for o in out) / len(out) if out else 0), c)))
    return out


def importance_rank(df: DataFrame, y: str, columns: list[str], k: int = 50, task: str = "classification", **fit) -> DataFrame:
    """(feature, importance): the k highest of one ensemble over all rows."""
    return importances_of(df.sparkSession, boost(df, y, columns, task, **fit)[0]).orderBy(F.desc("importance"), "feature").limit(k)


def select_features(df: DataFrame, y: str, columns: list[str], least: float = 0.5, k: int = 80, vif: float = 5.0, nmi: float = 0.1, clusters: float | None = None, task: str = "regression", **fit) -> DataFrame:
    """(stage, feature, score, kept): dependence, score filter, variance inflation, redundancy and trees, in this order, each over all rows that
    are complete for it. Features without a score count as zero and are listed. With `clusters` redundant features are clustered at that
    threshold instead of dropped pair by pair."""
    spark = df.sparkSession
    scores = {r["feature"]: r["score"] for r in dcor_scores(df, y, columns).collect()}
    out = [("dcor", c, scores.get(c), c in scores) for c in columns]
    table = spark.createDataFrame([(c, float(scores.get(c, 0.0))) for c in columns], "feature string, score double")
    live = [r["feature"] for r in score_filter(table, least, k).collect()]
    out += [("score", c, scores.get(c, 0.0), c in live) for c in columns]
    if len(live) > 1:
        rows = vif_select(df, sorted(live), vif).collect()
        out += [("vif", r["feature"], r["vif"], r["kept"]) for r in rows]
        live = [r["feature"] for r in rows if r["kept"]]
        rows = (mi_redundancy(df, sorted(live), scores, nmi) if clusters is None else mi_clusters(df, sorted(live), scores, clusters)).collect()
        out += [("redundancy", r["feature"], scores.get(r["feature"]), r["kept"]) for r in rows]
        live = [r["feature"] for r in rows if r["kept"]]
    if live:
        rows = embedded_select(df, y, sorted(live), task, **fit).collect()
        out += [("trees", r["feature"], r["importance"], r["kept"]) for r in rows]
    return spark.createDataFrame(out, "stage string, feature string, score double, kept boolean")


def post_selection_check(df: DataFrame, y: str, every: list[str], kept: list[str], task: str = "regression", **fit) -> DataFrame:
    """(n_before, n_after, score_before, score_after, drop, reduction_pct, efficiency) of ensembles with all features and with the kept ones, over
    the same folds. The score is the mean R2 (classes: F1) of the rows that check, or without folds of the rows learnt from; efficiency is the
    later score for each kept feature."""
    name = "r2" if task == "regression" else "f1"
    score = lambda ms: float(np.mean([m.metrics.get("check", m.metrics.get("train", {})).get(name, 0.0) for m in ms]))
    a, b = (score(fold_models(df, y, c, task, **fit)) for c in (every, kept))
    kind = "n_before int, n_after int, score_before double, score_after double, drop double, reduction_pct double, efficiency double"
    return df.sparkSession.createDataFrame([(len(every), len(kept), a, b, a - b, 100 * (1 - len(kept) / len(every)), b / len(kept))], kind)


#: Targets whose jobs share the cluster's cores.
TARGETS_TOGETHER = 4


def multi_target_sweep(df: DataFrame, targets: list[str], columns: list[str], **options) -> DataFrame:
    """select_features for each target, with its name. Jobs of several targets run side by side: the fits of one have a task for each fold, which
    leaves cores free."""
    one = inheritable_thread_target(df.sparkSession)(lambda y: select_features(df, y, columns, **options).withColumn("target", F.lit(y)))
    with ThreadPoolExecutor(TARGETS_TOGETHER) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, targets))
