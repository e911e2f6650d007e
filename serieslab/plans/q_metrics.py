"""Queries of evaluation metrics, dependence, selection, volatility and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from serieslab.core import materialise, shared_dir, table, windowed
from serieslab.operators import dependence as C
from serieslab.operators import metrics as M
from serieslab.operators import model as N
from serieslab.operators import selection as S
from serieslab.operators import volatility as V
from serieslab.operators.boosting import predicted
from serieslab.operators.sampling import time_split
from serieslab.plans.frames import D, L, P, events_series, forecasts, line_series, rounded, scored_documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, made, sql: str | None = None) -> None:
    QUERIES[name] = made
    if sql:
        ORACLE_SQL[name] = sql


_add(
    "regression_metrics", lambda s, f: rounded(M.regression_metrics(forecasts(s, f), "y", "p", "flag"), 4),
    f"WITH {P} SELECT flag, count(*) AS n, round(avg((y - p) ** 2), 4) AS mse, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2 FROM p GROUP BY flag",
)
_skill = "count(*) AS n, round(avg({y}), 4) AS mean_y, round(stddev_pop({y}), 4) AS std_y, round(avg(({y} - {p}) ** 2), 4) AS mse, round(avg({y} ** 2), 4) AS mse_zero, round(var_pop({y}), 4) AS mse_mean, round(1 - avg(({y} - {p}) ** 2) / avg({y} ** 2), 4) AS skill_zero, round(1 - avg(({y} - {p}) ** 2) / var_pop({y}), 4) AS skill_mean, round(sqrt(avg(({y} - {p}) ** 2)) / stddev_pop({y}), 4) AS nrmse"
_add("skill_scores", lambda s, f: rounded(M.skill_scores(forecasts(s, f), "y", "p", "flag"), 4), f"WITH {P} SELECT flag, {_skill.format(y='y', p='p')} FROM p GROUP BY flag")
_rank = lambda x: f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)"
_add("spearman_ic", lambda s, f: rounded(M.spearman_ic(forecasts(s, f), "y", "p")), f"WITH {P}, r AS (SELECT series, {_rank('y')}::DOUBLE AS a, {_rank('p')}::DOUBLE AS b FROM p) SELECT series, round(corr(a, b), 6) AS ic FROM r GROUP BY series")


def _next_values(s, f):
    """Each event's value with the one before it in its series as its forecast."""
    return windowed(events_series(s, f), {"p": lambda w: F.lag("x").over(w)}, back=1)


_add("ic_bootstrap", lambda s, f: rounded(M.ic_bootstrap(_next_values(s, f), "x", "p")))
_add(
    "directional_accuracy", lambda s, f: rounded(M.directional_accuracy(forecasts(s, f), "y", "p", "flag")),
    f"WITH {P} SELECT flag, round(coalesce(avg(CASE WHEN y <> 0 AND p <> 0 THEN (sign(y) = sign(p))::INTEGER END), 0.5), 6) AS accuracy FROM p GROUP BY flag",
)
_dm = (
    f"WITH {P}, d AS (SELECT series, idx, (y - p) ** 2 - y ** 2 AS d, count(*) OVER (PARTITION BY series) AS n, avg((y - p) ** 2 - y ** 2) OVER (PARTITION BY series) AS m FROM p), "
    "h AS (SELECT max(floor(4 * (n / 100) ** (2.0 / 9)))::BIGINT AS h FROM d), k AS (SELECT unnest(range(1, h + 1)) AS k FROM h), "
    "z AS (SELECT series, sum((d - m) ** 2) AS s FROM d GROUP BY series), c AS (SELECT a.series, k.k, sum((a.d - a.m) * (b.d - b.m)) AS c FROM d a, k JOIN d b ON b.series = a.series AND b.idx = a.idx - k.k GROUP BY ALL), "
    "v AS (SELECT series, sum(2 * (1 - k / (h + 1)) * c) AS v FROM c, h GROUP BY series), g AS (SELECT series, any_value(n) AS n, any_value(m) AS m FROM d GROUP BY series) "
    "SELECT series, n, round(m / sqrt((s + v) / n / n), 4) AS dm FROM g JOIN z USING (series) JOIN v USING (series)"
)
_add("diebold_mariano", lambda s, f: rounded(M.diebold_mariano(forecasts(s, f), "y", "p").select("series", "n", "dm"), 4), _dm)
_cut = "least(greatest({c} / sigma, q[1]), q[2])"
_add(
    "vol_adjusted_metrics", lambda s, f: rounded(M.vol_adjusted_metrics(forecasts(s, f), "y", "p", "sigma"), 4),
    f"WITH {P}, q AS (SELECT series, quantile_cont(y / sigma, [0.001, 0.999]) AS q FROM p GROUP BY series), c AS (SELECT series, {_cut.format(c='y')} AS y, {_cut.format(c='p')} AS p FROM p JOIN q USING (series)) SELECT series, {_skill.format(y='y', p='p')} FROM c GROUP BY series",
)
_add(
    "classification_metrics", lambda s, f: rounded(M.classification_metrics(scored_documents(s, f).withColumn("said", (F.col("s") > 0.02).cast("int")), "y", "said")),
    f"WITH {D}, a AS (SELECT y, (s > 0.02)::INTEGER AS p FROM d), c AS (SELECT y AS c, count(*) AS t, sum((y = p)::INTEGER) AS h FROM a GROUP BY y), g AS (SELECT p AS c, count(*) AS s FROM a GROUP BY p), "
    "e AS (SELECT c, t, h, coalesce(h / s, 0) AS pr, h / t AS re FROM c LEFT JOIN g USING (c)), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM e) "
    "SELECT sum(t)::BIGINT AS n, round(sum(h) / sum(t), 6) AS accuracy, round(sum(pr * t) / sum(t), 6) AS precision, round(sum(re * t) / sum(t), 6) AS recall, round(sum(f * t) / sum(t), 6) AS f1 FROM f",
)
_add(
    "auc_roc", lambda s, f: rounded(M.auc_roc(scored_documents(s, f), "y", "s")),
    f"WITH {D}, r AS (SELECT series, y, rank() OVER (PARTITION BY series ORDER BY s) + (count(*) OVER (PARTITION BY series, s) - 1) / 2.0::DOUBLE AS r FROM d), c AS (SELECT series, sum(y) AS pos, count(*) - sum(y) AS neg, sum(CASE WHEN y = 1 THEN r END) AS r FROM r GROUP BY series) "
    "SELECT series, round(CASE WHEN pos > 0 AND neg > 0 THEN (r - pos * (pos + 1) / 2) / (pos * neg) END, 6) AS auc FROM c",
)
_add(
    "average_precision", lambda s, f: rounded(M.average_precision(scored_documents(s, f), "y", "s")),
    f"WITH {D}, v AS (SELECT series, s, count(*) AS n, sum(y) AS p FROM d GROUP BY ALL), c AS (SELECT series, p, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY series) AS t FROM v WINDOW w AS (PARTITION BY series ORDER BY s DESC)) SELECT series, round(sum(p / t * tp / k), 6) AS ap FROM c WHERE t > 0 GROUP BY series",
)
_add(
    "brier_ece", lambda s, f: rounded(M.brier_ece(scored_documents(s, f), "y", "s")),
    f"WITH {D}, c AS (SELECT series, ceil(s * 10) AS b, count(*) AS n, avg(s) AS c, avg(y) AS a, sum((y - s) ** 2) AS q FROM d GROUP BY ALL) SELECT series, round(sum(q) / sum(n), 6) AS brier, round(sum(CASE WHEN b > 0 THEN abs(c - a) * n ELSE 0 END) / sum(n), 6) AS ece FROM c GROUP BY series",
)
_add(
    "precision_at_top", lambda s, f: rounded(M.precision_at_top(scored_documents(s, f), "y", "s", 0.2, "doc_id")),
    f"WITH {D}, r AS (SELECT series, y, row_number() OVER (PARTITION BY series ORDER BY s DESC, doc_id) AS r, count(*) OVER (PARTITION BY series) AS n FROM d) SELECT series, count(*) AS k, round(avg(y), 6) AS precision FROM r WHERE r <= greatest(1, floor(n * 0.2)) GROUP BY series",
)
_add(
    "fold_mean", lambda s, f: rounded(M.fold_mean(M.regression_metrics(forecasts(s, f), "y", "p", "flag").unpivot(["flag"], ["mse", "mae"], "metric", "value")), 4),
    f"WITH {P}, k AS (SELECT flag, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae FROM p GROUP BY flag), u AS (UNPIVOT k ON mse, mae INTO NAME metric VALUE value) SELECT metric, round(avg(value), 4) AS mean, count(*) AS folds FROM u GROUP BY metric",
)


def _sweep(s, f):
    return table(s, f, "lineitem").select(F.col("l_linenumber").alias("horizon"), (1 - F.col("l_discount") * 10).alias("r2"))


_add("sweep_report", lambda s, f: rounded(M.sweep_report(_sweep(s, f), 0.5)), "SELECT l_linenumber AS horizon, count(*) AS n, round(avg(1 - l_discount * 10), 6) AS mean, round(max(1 - l_discount * 10), 6) AS best, count(*) FILTER (1 - l_discount * 10 > 0.5) AS above FROM lineitem GROUP BY 1")
# dependence and selection
_add("pearson_prefilter", lambda s, f: rounded(C.pearson_prefilter(line_series(s, f), "v", ["q", "d", "t"], 2)), f"WITH {L} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, v)), 6) AS score FROM l" for c in "qdt"))
_dcor = (
    f"WITH {L}, k AS (SELECT idx, q AS x, v AS y FROM l WHERE idx >= (SELECT count(*) FROM l) - 600), p AS (SELECT a.idx AS i, b.idx AS j, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM k a, k b), "
    "c AS (SELECT a - avg(a) OVER (PARTITION BY i) - avg(a) OVER (PARTITION BY j) + avg(a) OVER () AS a, b - avg(b) OVER (PARTITION BY i) - avg(b) OVER (PARTITION BY j) + avg(b) OVER () AS b FROM p) "
    "SELECT 'q' AS feature, 600::BIGINT AS n, round(greatest(sum(a * b), 0) / sqrt(sum(a * a) * sum(b * b)), 6) AS dcor2, round(sqrt(greatest(sum(a * b), 0) / sqrt(sum(a * a) * sum(b * b))), 6) AS dcor FROM c"
)
_add("dcor_small", lambda s, f: rounded(C.distance_corr(line_series(s, f), "v", ["q"], 600)), _dcor)  # the last 600 pairs: the operator's own limit, as small as the SQL needs
_add("dcor_all", lambda s, f: rounded(C.distance_corr(table(s, f, "lineitem").selectExpr("l_extendedprice v", "l_quantity q", "l_discount d", "l_tax t"), "v", ["q", "d", "t"], None)))  # all pairs: no order of rows
_add("dcor_scores", lambda s, f: rounded(C.dcor_scores(line_series(s, f), "v", ["q", "d", "t"])))
_add("dcor_permutation", lambda s, f: rounded(C.dcor_permutation(line_series(s, f), "v", ["q", "d"])))
_dpair = lambda c: ", ".join(f"sum(abs(i.{c} - j.{c}){m}) AS {c}{n}" for n, m in (("a", ""), ("p", " * abs(i.v - j.v)"), ("s", f" * abs(i.{c} - j.{c})")))
_dcen = lambda p, r, u, w: f"(sum({p}) - 2 / 1200.0 * sum({r}) + sum({u}) * sum({w}) / 1200.0 / 1200.0)"
_add(
    "dcor_rolling", lambda s, f: rounded(C.dcor_rolling(line_series(s, f), "v", ["q", "d"])),
    f"WITH {L}, n AS (SELECT (max(idx) + 1 - 1200) // 500 AS k FROM l), a AS (SELECT k * 500 + 1200 AS top, unnest(range(greatest(0, k - 19), k + 1)) * 500 + 1200 AS anchor FROM n), "
    "r AS (SELECT anchor, idx, q::DOUBLE AS q, d::DOUBLE AS d, v::DOUBLE AS v FROM l JOIN a ON idx >= anchor - 1200 AND idx < anchor), "
    f"s AS (SELECT i.anchor, i.idx, {_dpair('q')}, {_dpair('d')}, sum(abs(i.v - j.v)) AS va, sum((i.v - j.v) ** 2) AS vs FROM r i JOIN r j ON i.anchor = j.anchor GROUP BY i.anchor, i.idx), "
    + "c AS (" + " UNION ALL ".join(f"SELECT anchor, '{c}' AS feature, greatest({_dcen(f'{c}p', f'{c}a * va', f'{c}a', 'va')}, 0) / sqrt({_dcen(f'{c}s', f'{c}a * {c}a', f'{c}a', f'{c}a')} * {_dcen('vs', 'va * va', 'va', 'va')}) AS r FROM s GROUP BY anchor" for c in "qd") + ") "
    + "SELECT 'lineitem' AS series, feature, count(*) AS windows, round(median(r), 6) AS median, round(avg(r), 6) AS mean, round(min(r), 6) AS min, round(max(r), 6) AS max, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.75), 6) AS p75 FROM c GROUP BY feature",
)
_edge = lambda c: f"least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 32), 31)"
_pairs = [("q", "v"), ("q", "d"), ("d", "t")]
_h = lambda *k: f"(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM b) AS p FROM b GROUP BY {', '.join(k)}))"
_add(
    "nmi_pairs", lambda s, f: rounded(C.nmi_pairs(line_series(s, f), _pairs)),
    f"WITH {L}, b AS (SELECT {', '.join(f'{_edge(c)} AS {c}' for c in 'qvdt')} FROM l) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(greatest(0, least(1, ({_h(a)} + {_h(b)} - {_h(a, b)}) / greatest({_h(a)}, {_h(b)}))), 6) AS nmi" for a, b in _pairs),
)


def _importances(s, f):
    return table(s, f, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.avg("p_size") - 20).alias("importance"))


def _cut(rule: float):
    return lambda s, f: (lambda d: rounded(d.where(F.col("importance") >= S.importance_threshold(d, f"p{int(rule * 100)}"))))(_importances(s, f))


_add(
    "importance_threshold", _cut(0.75),
    "WITH i AS (SELECT p_brand AS feature, avg(p_size) - 20 AS importance FROM part GROUP BY 1) SELECT feature, round(importance, 6) AS importance FROM i WHERE importance >= (SELECT quantile_cont(importance, 0.75) FROM i WHERE importance > 0)",
)
_add(
    "score_filter", lambda s, f: rounded(S.score_filter(_importances(s, f).select("feature", (F.col("importance") / 30 + 0.5).alias("score")), 0.4, 20)),
    "SELECT p_brand AS feature, round((avg(p_size) - 20) / 30 + 0.5, 6) AS score FROM part GROUP BY 1 HAVING (avg(p_size) - 20) / 30 + 0.5 >= 0.4 ORDER BY (avg(p_size) - 20) / 30 + 0.5 DESC, 1 LIMIT 20",
)


def _wide(s, f, n: int = 64):
    """All dimensions of the embeddings, and a column that two of them give."""
    cols = [F.col("embedding")[i].cast("double").alias(f"x_{i}") for i in range(n)]
    rows = table(s, f, "embeddings").select(F.lit("all").alias("series"), F.col("vec_id").alias("idx"), F.col("label").cast("double").alias("y"), *cols)
    made = materialise(rows.withColumn("x_sum", F.col("x_0") + F.col("x_1")))  # fits make many passes over it
    return made, [f"x_{i}" for i in range(n)] + ["x_sum"]


_add("vif_select", lambda s, f: rounded(S.vif_select(*_wide(s, f)), 4))
def _scored(s, f):
    """The wide table, its columns, and their dependence on the label."""
    df, columns = _wide(s, f)
    return df, columns, {r["feature"]: r["score"] for r in C.pearson_prefilter(df, "y", columns).collect()}


_add("mi_redundancy", lambda s, f: S.mi_redundancy(*_scored(s, f), 0.1))
_add("mi_clusters", lambda s, f: S.mi_clusters(*_scored(s, f), 0.3))
# trees grow with the parameters in force; the score filter lets all features pass, so that the later stages have work
_add("embedded_select", lambda s, f: (lambda d, c: rounded(S.embedded_select(d, "y", c, least_train=10)))(*_wide(s, f)))
_add("fold_metrics", lambda s, f: (lambda d, c: rounded(S.fold_metrics(s, S.fold_models(d, "y", c, least_train=10))))(*_wide(s, f)))
_add("stability_select", lambda s, f: (lambda d, c: rounded(S.stability_select(d, "y", c, least_train=10)))(*_wide(s, f)))
_add("importance_rank", lambda s, f: (lambda d, c: rounded(S.importance_rank(d.withColumn("y", (F.col("y") % 2)), "y", c)))(*_wide(s, f)))
_add("select_features", lambda s, f: (lambda d, c: rounded(S.select_features(d, "y", c, least=0.0, clusters=0.3, least_train=10), 4))(*_wide(s, f)))
_add("post_selection_check", lambda s, f: (lambda d, c: rounded(S.post_selection_check(d, "y", c, c[:4], least_train=10), 4))(*_wide(s, f)))
_add("train_final", lambda s, f: (lambda d, c: rounded(N.train_final(d, "y", c)[1], 4))(*_wide(s, f)))
_mid = lambda x: f"(rank() OVER (PARTITION BY split ORDER BY {x}) + (count(*) OVER (PARTITION BY split, {x}) - 1) / 2.0)::DOUBLE"
_add(
    "evaluate_final", lambda s, f: rounded(N.evaluate(time_split(forecasts(s, f)).withColumnRenamed("p", "prediction")), 4),
    f"WITH {P}, s AS (SELECT *, CASE WHEN idx < floor(count(*) OVER (PARTITION BY series) * 0.8) THEN 'train' ELSE 'test' END AS split FROM p), i AS (SELECT split, corr(a, b) AS ic FROM (SELECT split, {_mid('y')} AS a, {_mid('p')} AS b FROM s) GROUP BY split) "
    "SELECT split, count(*) AS n, round(avg((y - p) ** 2), 4) AS mse, round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2, round(1 - avg((y - p) ** 2) / avg(y ** 2), 4) AS skill_zero, round(any_value(ic), 4) AS ic, "
    'round(avg(p), 4) AS pred_mean, round(stddev_pop(p), 4) AS pred_std, round(avg(y), 4) AS target_mean, round(stddev_pop(y), 4) AS target_std, round(1 - avg((y - p) ** 2) / avg(y ** 2), 4) AS "primary" FROM s JOIN i USING (split) GROUP BY split',
)
_cells = lambda e: f"sum(({e})::INTEGER)::DOUBLE"
_add(
    "evaluate_classes", lambda s, f: rounded(N.evaluate(scored_documents(s, f).select(F.col("series").alias("split"), "y", (F.col("s") > 0.02).cast("int").alias("prediction")), "classification")),
    f"WITH {D}, a AS (SELECT series AS split, y, (s > 0.02)::INTEGER AS p FROM d), c AS (SELECT split, count(*)::DOUBLE AS n, avg(p) AS pm, stddev_pop(p) AS ps, avg(y) AS ym, stddev_pop(y) AS ys, {_cells('y = 1 AND p = 1')} AS tp, {_cells('y = 0 AND p = 1')} AS fp, {_cells('y = 1 AND p = 0')} AS fn, {_cells('y = 0 AND p = 0')} AS tn FROM a GROUP BY split), "
    "k AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, tp / nullif(tp + fn, 0) AS r1, tn / nullif(tn + fp, 0) AS r0 FROM c), "
    "g AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0 FROM k), w AS (SELECT *, (tp + fn) / n AS w1, (tn + fp) / n AS w0 FROM g) "
    "SELECT split, n::BIGINT AS n, round((tp + tn) / n, 6) AS accuracy, round(p1 * w1 + p0 * w0, 6) AS precision, round(coalesce(r1, 0) * w1 + coalesce(r0, 0) * w0, 6) AS recall, round(f1 * w1 + f0 * w0, 6) AS f1, round(CASE WHEN w1 > 0 AND w0 > 0 THEN (r1 + r0) / 2 END, 6) AS auc, "
    'round(pm, 6) AS pred_mean, round(ps, 6) AS pred_std, round(ym, 6) AS target_mean, round(ys, 6) AS target_std, round(f1 * w1 + f0 * w0, 6) AS "primary" FROM w',
)


# volatility: the path follows fixed parameters and has a return for every row, so that SQL can check what is taken from it
def _path(s, f):
    r = materialise(V.all_log_returns(events_series(s, f), "x"))  # passed over for the variance, its sums and the path
    fits = V.variance_of_returns(r).select("series", (F.col("v") * 0.1).alias("omega"), F.lit(0.1).alias("alpha"), F.lit(0.8).alias("beta"), F.lit(0.9).alias("persistence"))
    return V.conditional_variance(r, fits), fits


_add("garch_fit", lambda s, f: rounded(V.garch_fit(events_series(s, f), "x"), 4))
_add("garch_rolling", lambda s, f: rounded(V.garch_rolling(events_series(s, f), "x"), 4))
_gpath = (
    "WITH RECURSIVE e AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS x FROM events), "
    "r AS (SELECT series, idx - 1 AS idx, ln(x / lag(x) OVER (PARTITION BY series ORDER BY idx)) AS r FROM e QUALIFY idx > 0), v AS (SELECT series, var_pop(r) AS v FROM r GROUP BY series), "
    "p(series, idx, r, h, v) AS (SELECT r.series, idx, r, v, v FROM r JOIN v USING (series) WHERE idx = 0 UNION ALL SELECT p.series, r.idx, r.r, 0.1 * p.v + 0.1 * p.r * p.r + 0.8 * p.h, p.v FROM p JOIN r ON r.series = p.series AND r.idx = p.idx + 1) "
)
_add("conditional_variance", lambda s, f: rounded(_path(s, f)[0]), _gpath + "SELECT series, idx, round(r, 6) AS r, round(h, 6) AS h FROM p")
_add("garch_loglik", lambda s, f: rounded(V.garch_loglik(_path(s, f)[0]), 4), _gpath + "SELECT series, round(-0.5 * sum(ln(2 * pi()) + ln(h) + r * r / h), 4) AS loglik FROM p GROUP BY series")
_sk = lambda x: f"((sum({x} ** 3) / count({x}) - 3 * avg({x}) * sum({x} ** 2) / count({x}) + 2 * avg({x}) ** 3) / stddev_pop({x}) ** 3)"
_add(
    "vol_statistics", lambda s, f: rounded(V.vol_statistics(_path(s, f)[0]), 5),
    _gpath + f", q AS (SELECT series, sqrt(h) AS v FROM p) SELECT series, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round({_sk('v')}, 5) AS skew, round(kurtosis_pop(v) + 3, 5) AS kurt, round(min(v), 5) AS min, round(max(v), 5) AS max, round(median(v), 5) AS median, round(quantile_cont(v, 0.25), 5) AS q25, round(quantile_cont(v, 0.75), 5) AS q75, round(max(v) - min(v), 5) AS range, round(stddev_pop(v) / avg(v), 5) AS cv FROM q GROUP BY series",
)
_add(
    "vol_autocorr", lambda s, f: rounded(V.vol_autocorr(_path(s, f)[0])),
    _gpath + "SELECT a.series, k.lag, round(coalesce(corr(sqrt(a.h), sqrt(b.h)), 0), 6) AS r FROM p a, (SELECT unnest([1, 5, 10, 20, 50])::INTEGER AS lag) k JOIN p b ON b.series = a.series AND b.idx = a.idx - k.lag GROUP BY a.series, k.lag",
)
_add(
    "residual_stats", lambda s, f: rounded(V.residual_stats(_path(s, f)[0]), 4),
    _gpath + f", z AS (SELECT series, r / sqrt(h) AS z FROM p) SELECT series, round(avg(z), 4) AS mean, round(stddev_pop(z), 4) AS std, round({_sk('z')}, 4) AS skew, round(kurtosis_pop(z) + 3, 4) AS kurt, count(*) AS n, round(count(*) * ({_sk('z')} ** 2 / 6 + kurtosis_pop(z) ** 2 / 24), 4) AS jb FROM z GROUP BY series",
)
_add(
    "vol_forecast", lambda s, f: rounded(V.vol_forecast(*_path(s, f))),
    _gpath + "SELECT series, k.horizon, round(sqrt(v + 0.9 ** k.horizon * (h - v)), 6) AS vol FROM (SELECT series, any_value(v) AS v, max_by(h, idx) AS h FROM p GROUP BY series), (SELECT unnest([1, 5, 10, 20])::INTEGER AS horizon) k",
)
_add(
    "vol_diagnostics", lambda s, f: rounded(V.vol_diagnostics(*_path(s, f))),
    _gpath + ", c AS (SELECT a.series, corr(sqrt(a.h), sqrt(b.h)) AS c FROM p a JOIN p b ON b.series = a.series AND b.idx = a.idx - 1 GROUP BY a.series) SELECT p.series, round(stddev_pop(CASE WHEN r < 0 THEN r END) / stddev_pop(CASE WHEN r > 0 THEN r END), 6) AS asymmetry, round(any_value(c), 6) AS clustering, 0.1::DOUBLE AS reversion, round(ln(0.5) / ln(0.9), 6) AS half_life FROM p JOIN c USING (series) GROUP BY p.series",
)


def _saved(s, f):
    """Predictions of a model that was saved and loaded again."""
    df, columns = _wide(s, f)
    model, _ = N.train_final(df, "y", columns)
    path = f"{shared_dir(s)}/model-{uuid.uuid4().hex}"
    N.save_model(s, model, path, s.createDataFrame([("all", len(columns))], "series string, n_features int"))
    loaded, meta = N.load_model(s, path)
    return rounded(predicted(df, loaded).select("idx", "prediction").join(F.broadcast(meta.select("n_features"))), 4)  # one row


_add("load_model", _saved)
_add("corr_preprune", lambda s, f: (lambda d, c: s.createDataFrame([(x,) for x in S.corr_preprune(d, c, 0.6)], "feature string"))(*_wide(s, f)))


def _mrmr(s, f):
    df, columns = _wide(s, f)
    scores = {r["feature"]: r["score"] for r in C.pearson_prefilter(df, "y", columns).collect()}
    r = C.correlation(df, columns)
    pairs = {(a, b): abs(float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j}
    return s.createDataFrame(list(enumerate(S.mrmr(scores, pairs, 5))), "place int, feature string")


_add("mrmr", _mrmr)
