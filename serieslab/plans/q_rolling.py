"""Queries of the window, stationarising and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieslab.operators import rolling as R
from serieslab.operators import stationary as S
from serieslab.operators import stats as T
from serieslab.plans.frames import E, L, events_series, line_series, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, made, sql: str | None = None) -> None:
    QUERIES[name] = made
    if sql:
        ORACLE_SQL[name] = sql


def _events(made, *columns: str):
    return lambda spark, sf: rounded(made(events_series(spark, sf)).select(*columns))


def _line(made, *columns: str):
    return lambda spark, sf: rounded(made(line_series(spark, sf)).select(*columns))


def _w(k: int, by: str = "series") -> str:
    return f"(PARTITION BY {by} ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _z(k: int, least: int) -> str:
    w = _w(k)
    return f"CASE WHEN count(x) OVER {w} >= {least} THEN (x - avg(x) OVER {w}) / nullif(stddev_samp(x) OVER {w}, 0) END"


_add("rolling_zscore", _events(lambda d: R.rolling_zscore(d, "x", 20, 5), "series", "idx", "z"), f"WITH {E} SELECT series, idx, round({_z(20, 5)}, 6) AS z FROM e")

_g = lambda f: f"round(CASE WHEN count(x) OVER {_w(20)} >= 5 THEN {f}(x) OVER {_w(20)} END, 6)"
_add(
    "rolling_stats", _events(lambda d: R.rolling_stats(d, "x", 20, 5), "series", "idx", "mean", "std", "sum", "min", "max"),
    f"WITH {E} SELECT series, idx, {_g('avg')} AS mean, {_g('stddev_samp')} AS std, {_g('sum')} AS sum, {_g('min')} AS min, {_g('max')} AS max FROM e",
)
_add("rolling_quantile", _events(lambda d: R.rolling_quantile(d, "x", 200, 0.9, 20, "q90"), "series", "idx", "q90"), f"WITH {E} SELECT series, idx, round(CASE WHEN count(x) OVER {_w(200)} >= 20 THEN quantile_cont(x, 0.9) OVER {_w(200)} END, 6) AS q90 FROM e")
_add("rolling_median", _events(lambda d: R.rolling_quantile(d, "x", 15), "series", "idx", "median"), f"WITH {E} SELECT series, idx, round(median(x) OVER {_w(15)}, 6) AS median FROM e")
_add(
    "volume_zscores", _events(lambda d: R.volume_zscores(d, "x"), "series", "idx", "z15", "z60", "z15_lag"),
    f"WITH {E}, z AS (SELECT series, idx, {_z(15, 5)} AS z15, {_z(60, 20)} AS z60 FROM e) SELECT series, idx, round(z15, 6) AS z15, round(z60, 6) AS z60, round(lag(z15) OVER (PARTITION BY series ORDER BY idx), 6) AS z15_lag FROM z",
)
_o = "OVER (PARTITION BY series ORDER BY idx)"
_add(
    "lag_diff_logret", _events(lambda d: R.shifts(d, "x", 3), "series", "idx", "lag", "lead", "diff", "log_return"),
    f"WITH {E} SELECT series, idx, round(lag(x, 3) {_o}, 6) AS lag, round(lead(x, 3) {_o}, 6) AS lead, round(x - lag(x) {_o}, 6) AS diff, round(CASE WHEN x > 0 AND lag(x) {_o} > 0 THEN ln(x) - ln(lag(x) {_o}) END, 6) AS log_return FROM e",
)
_ma, _mb = f"avg(q) OVER {_w(50)}", f"avg(d) OVER {_w(50)}"
_add(
    "rolling_relationship", _line(lambda d: R.rolling_relationship(d, "q", "d", 50), "idx", "relationship"),
    f"WITH {L} SELECT idx, round(greatest(-1.0, least(1.0, {_ma} * {_mb} / (abs({_ma}) + abs({_mb}) + 1e-8))), 6) AS relationship FROM l",
)
_add("rolling_corr", _line(lambda d: R.rolling_corr(d, "q", "v", 60, 30), "idx", "corr"), f"WITH {L} SELECT idx, round(CASE WHEN count(*) OVER {_w(60)} >= 30 THEN corr(q, v) OVER {_w(60)} END, 6) AS corr FROM l")
_add(
    "rolling_coverage", _events(lambda d: R.rolling_coverage(d.withColumn("y", F.when(F.col("event_id") % 3 != 0, F.col("x"))), "y", 12, 8), "series", "idx", "covered"),
    f"WITH {E} SELECT series, idx, count(CASE WHEN event_id % 3 <> 0 THEN x END) OVER {_w(12)} >= 8 AS covered FROM e",
)
_u = "OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_add(
    "rolling_vol", _events(lambda d: R.rolling_vol(d, "x", 50, 10), "series", "idx", "sigma"),
    f"WITH {E} SELECT series, idx, round(greatest(coalesce(CASE WHEN count(x) OVER {_w(50)} >= 10 THEN stddev_samp(x) OVER {_w(50)} END, stddev_samp(x) {_u}, 1e-6), 1e-6), 6) AS sigma FROM e",
)


def _t(slope: str, sxx: str, syy: str, m: str) -> str:
    rss = f"greatest({syy} - {slope} * {slope} * {sxx}, 0)"
    return f"CASE WHEN {sxx} > 0 AND {m} > 2 AND {rss} > 0 THEN {slope} / sqrt({rss} / ({m} - 2) / {sxx}) END"


_k = _w(59)
_add(
    "rolling_adf", _events(lambda d: R.rolling_df_tstat(d, "x", 60, 40), "series", "idx", "adf_t"),
    f"WITH {E}, b AS (SELECT series, idx, x, lag(x) {_o} AS b FROM e), r AS (SELECT series, idx, regr_slope(x - b, b) OVER {_k} AS s, regr_sxx(x - b, b) OVER {_k} AS sxx, regr_syy(x - b, b) OVER {_k} AS syy, regr_count(x - b, b) OVER {_k} AS m FROM b) "
    f"SELECT series, idx, round(CASE WHEN m >= 39 THEN {_t('s', 'sxx', 'syy', 'm')} END, 6) AS adf_t FROM r",
)
_add(
    "cyclical_component", lambda s, f: rounded(R.cyclical_components(events_series(s, f), "x").select("series", "idx", "cycle_20", "cycle_50", "cycle_100"), 9),
    f"WITH {E} SELECT series, idx, " + ", ".join(f"round(x - avg(x) OVER {_w(p)}, 9) AS cycle_{p}" for p in (20, 50, 100)) + " FROM e",
)
_add(
    "average_rank", _line(lambda d: R.average_ranks(d, "q"), "idx", "rank"),
    f"WITH {L} SELECT idx, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE AS rank FROM l",
)
_add(
    "latest_per_key", lambda s, f: R.latest_per_key(s.read.parquet(f"{f}/events.parquet").select("user_id", "event_id", "event_type", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")]),
    "SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
_p = lambda t: f"CASE WHEN {t} <= -3.43 THEN 0.01 WHEN {t} <= -2.86 THEN 0.05 WHEN {t} <= -2.57 THEN 0.1 ELSE 1.0 END::DOUBLE"


# stationarising
def _fractional(d: float, most: int) -> str:
    """SQL of a fractional difference; the weights come from their own recursion there."""
    return (
        f"WITH RECURSIVE {E}, r(j, c) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT j + 1, c * (j - {d}) / (j + 1) FROM r WHERE j < {most}), "
        "s AS (SELECT j, c, sum(abs(c)) OVER (ORDER BY j) AS upto, sum(abs(c)) OVER () AS whole FROM r), w AS (SELECT j, c FROM s WHERE upto - abs(c) < (1 - 1e-5) * whole) "
        "SELECT e.series, e.idx, round(CASE WHEN e.idx >= (SELECT count(*) FROM w) - 1 THEN sum(w.c * b.x) END, 6) AS fd FROM e, w LEFT JOIN e b ON b.series = e.series AND b.idx = e.idx - w.j GROUP BY e.series, e.idx"
    )


_add("fracdiff_short", _events(lambda d: S.fracdiff(d, "x", 0.4, 15), "series", "idx", "fd"), _fractional(0.4, 15))
_add("fracdiff_long", _events(lambda d: S.fracdiff(d, "x", 0.5, 200), "series", "idx", "fd"), _fractional(0.5, 200))


def _orders(orders: tuple[float, ...]) -> str:
    """SQL of g(series, d, n, t, p, var_ratio): the test and the variance ratio of the difference of each order, with up to 1000 lags."""
    return (
        f"WITH RECURSIVE {E}, o AS (SELECT unnest({list(orders)})::DOUBLE AS d), r(d, j, c) AS (SELECT d, 0, 1.0::DOUBLE FROM o UNION ALL SELECT d, j + 1, c * (j - d) / (j + 1) FROM r WHERE j < 1000), "
        "s AS (SELECT d, j, c, sum(abs(c)) OVER (PARTITION BY d ORDER BY j) AS upto, sum(abs(c)) OVER (PARTITION BY d) AS whole FROM r), w AS (SELECT d, j, c FROM s WHERE upto - abs(c) < (1 - 1e-5) * whole), "
        "k AS (SELECT d, count(*) AS k FROM w GROUP BY d), y AS (SELECT w.d, b.series, b.idx + w.j AS idx, sum(w.c * b.x) AS y FROM w, e b JOIN k ON k.d = w.d WHERE b.idx + w.j >= k.k - 1 GROUP BY ALL), "
        "z AS (SELECT d, series, idx, y, lag(y) OVER (PARTITION BY d, series ORDER BY idx) AS b FROM y JOIN e USING (series, idx)), "
        "q AS (SELECT d, series, count(y) AS n, var_pop(y) AS vy, regr_slope(y - b, b) AS s, regr_sxx(y - b, b) AS sxx, regr_syy(y - b, b) AS syy, regr_count(y - b, b) AS m FROM z GROUP BY ALL), v AS (SELECT series, var_pop(x) AS vx FROM e GROUP BY series), "
        f"t AS (SELECT v.series, k.d, coalesce(n, 0) AS n, {_t('s', 'sxx', 'syy', 'm')} AS t, vy / vx AS var_ratio FROM k CROSS JOIN v LEFT JOIN q ON q.d = k.d AND q.series = v.series), "
        f"g AS (SELECT series, d, n, t, CASE WHEN n < 50 THEN 1.0 ELSE {_p('t')} END::DOUBLE AS p, var_ratio FROM t) "
    )


_add("fracdiff_grid", lambda s, f: rounded(S.fracdiff_grid(events_series(s, f), "x"), 4), _orders((0.1, 0.3, 0.5, 0.7, 0.9)) + "SELECT series, d, n, round(t, 4) AS t, p, round(var_ratio, 4) AS var_ratio FROM g")
_add(
    "fracdiff_search", lambda s, f: rounded(S.fracdiff_search(events_series(s, f), "x"), 4),
    _orders((0.1, 0.2, 0.3, 0.4, 0.5)) + "SELECT series, d, p <= 0.05 AS found, p, round(var_ratio, 4) AS var_ratio FROM g QUALIFY row_number() OVER (PARTITION BY series ORDER BY p > 0.05, CASE WHEN p <= 0.05 THEN d ELSE abs(var_ratio - 1) END, d) = 1",
)
for _kind, _f in (("log", "ln"), ("sqrt", "sqrt")):
    _add(
        f"variance_{_kind}", _events(lambda d, k=_kind: S.variance_stabilised(d, "x", k), "series", "idx", "vs"),
        f"WITH {E} SELECT series, idx, round({_f}(x + CASE WHEN min(x) OVER (PARTITION BY series) <= 0 THEN abs(min(x) OVER (PARTITION BY series)) + 1e-8 ELSE 1e-8 END), 6) AS vs FROM e",
    )
_add(
    "baxter_king", _events(lambda d: S.baxter_king(d, "x"), "series", "idx", "bk"),
    f"WITH {E}, h AS (SELECT m + 12 AS j, CASE WHEN m = 0 THEN 2.0 / 6 - 2.0 / 32 ELSE (sin(2 * pi() * abs(m) / 6) - sin(2 * pi() * abs(m) / 32)) / (pi() * abs(m)) END AS c FROM (SELECT unnest(range(-12, 13)) AS m)), "
    "w AS (SELECT j, c - avg(c) OVER () AS c FROM h) SELECT e.series, e.idx, round(CASE WHEN e.idx >= 24 THEN sum(w.c * b.x) END, 6) AS bk FROM e, w LEFT JOIN e b ON b.series = e.series AND b.idx = e.idx - w.j GROUP BY e.series, e.idx",
)
_add(
    "fill_borders", _events(lambda d: S.fill_borders(d, "x", 12, "b"), "series", "idx", "b"),
    f"WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM e), i AS (SELECT series, min_by(x, idx) AS f, max_by(x, idx) AS g FROM n WHERE idx >= 12 AND idx < n - 12 GROUP BY series) "
    "SELECT series, idx, round(CASE WHEN idx < 12 THEN f WHEN idx >= n - 12 THEN g ELSE x END, 6) AS b FROM n LEFT JOIN i USING (series)",
)
_add(
    "seasonal_decompose", lambda s, f: rounded(S.seasonal_decompose(events_series(s, f), "x", 24).select("series", "idx", "trend", "seasonal", "resid"), 9),
    f"WITH {E}, t AS (SELECT *, avg(x) OVER {_w(24)} AS trend FROM e), s AS (SELECT series, idx % 24 AS k, avg(x - trend) AS seasonal FROM t GROUP BY ALL) SELECT t.series, idx, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(x - trend - seasonal, 9) AS resid FROM t JOIN s ON s.series = t.series AND s.k = t.idx % 24",
)
_add(
    "spectral_features", lambda s, f: rounded(S.spectral_features(events_series(s, f), "x")),
    f"WITH {E}, b AS (SELECT series, idx // 256 AS block, idx % 256 AS k, x, count(*) OVER w AS n, avg(x) OVER w AS m FROM e WINDOW w AS (PARTITION BY series, idx // 256)), "
    "c AS (SELECT series, block, f / 256.0::DOUBLE AS f, sum((x - m) * cos(2 * pi() * f * k / 256)) ** 2 + sum((x - m) * sin(2 * pi() * f * k / 256)) ** 2 AS p FROM b, (SELECT unnest(range(1, 129)) AS f) WHERE n = 256 GROUP BY series, block, f), "
    "s AS (SELECT series, block, f, p, p / sum(p) OVER (PARTITION BY series, block) AS r FROM c) "
    "SELECT series, block, 256::BIGINT AS n, round(arg_max(f, p), 6) AS dominant, round(-sum(r * ln(r + 1e-9)), 6) AS entropy, round(sum(f * r), 6) AS centroid FROM s GROUP BY series, block",
)
_add("rolling_modes", lambda s, f: S.rolling_modes(line_series(s, f), "q", 500, 50))
# statistics
_b = f"b AS (SELECT series, idx, x, lag(x) {_o} AS b FROM e)"
_add(
    "df_test", _events(lambda d: T.df_test(d, "x"), "series", "n", "t", "p"),
    f"WITH {E}, {_b}, r AS (SELECT series, count(x) AS n, regr_slope(x - b, b) AS s, regr_sxx(x - b, b) AS sxx, regr_syy(x - b, b) AS syy, regr_count(x - b, b) AS m FROM b GROUP BY series), t AS (SELECT series, n, {_t('s', 'sxx', 'syy', 'm')} AS t FROM r) SELECT series, n, round(t, 6) AS t, CASE WHEN n < 50 THEN 1.0 ELSE {_p('t')} END::DOUBLE AS p FROM t",
)
_add(
    "variance_ratio", _events(lambda d: T.variance_ratio(d, "x"), "series", "ratio", "stationary"),
    f"WITH {E}, {_b}, d AS (SELECT series, idx, x - b AS d FROM b WHERE b IS NOT NULL), v AS (SELECT series, var_pop(d) AS v, count(*) AS n FROM d GROUP BY series), "
    "s AS (SELECT series, q, (idx - 1) // q AS g, sum(d) AS s, count(*) AS c FROM d, (SELECT unnest([2, 4, 8, 16]) AS q) GROUP BY ALL), u AS (SELECT series, q, var_pop(s) AS vq FROM s WHERE c = q GROUP BY ALL), "
    "r AS (SELECT series, avg(vq / (q * v)) AS ratio FROM u JOIN v USING (series) WHERE n >= 2 * q GROUP BY series) SELECT series, round(ratio, 6) AS ratio, abs(ratio - 1) < 0.1 AS stationary FROM r",
)
_skew = lambda x: f"((sum({x} ** 3) / count({x}) - 3 * avg({x}) * sum({x} ** 2) / count({x}) + 2 * avg({x}) ** 3) / stddev_pop({x}) ** 3)"
_add(
    "moments", _events(lambda d: T.moments(d, "x"), "series", "mean", "std", "skew", "kurt"),
    f"WITH {E} SELECT series, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round({_skew('x')}, 6) AS skew, round(kurtosis_pop(x) + 3, 6) AS kurt FROM e GROUP BY series",
)
_add(
    "summaries", lambda s, f: rounded(T.summaries(line_series(s, f), ["q", "v", "d", "t"]), 4),
    f"WITH {L}, u AS (UNPIVOT (SELECT series, q, v, d, t FROM l) ON q, v, d, t INTO NAME feature VALUE value) SELECT series, feature, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(median(value), 4) AS median, round({_skew('value')}, 4) AS skew, round(kurtosis_pop(value) + 3, 4) AS kurt FROM u GROUP BY series, feature",
)
_add(
    "autocorr", _events(lambda d: T.autocorr(d, "x", [1, 5, 10, 20]), "series", "lag", "r"),
    f"WITH {E}, k AS (SELECT unnest([1, 5, 10, 20])::INTEGER AS lag) SELECT a.series, k.lag, round(coalesce(corr(a.x, b.x), 0), 6) AS r FROM e a, k JOIN e b ON b.series = a.series AND b.idx = a.idx - k.lag GROUP BY a.series, k.lag",
)
_add("trend_strength", _events(lambda d: T.trend_strength(d, "x"), "series", "trend"), f"WITH {E} SELECT series, round(abs(regr_slope(x, idx)) / (stddev_pop(x) + 1e-9), 6) AS trend FROM e GROUP BY series")
_add(
    "hist_entropy", _events(lambda d: T.hist_entropy(d, "x"), "series", "bins", "entropy"),
    f"WITH {E}, m AS (SELECT series, min(x) AS lo, max(x) AS hi, least(50, count(x) // 10)::INTEGER AS bins, count(x) AS n FROM e GROUP BY series), c AS (SELECT series, bins, n, least(floor((x - lo) / (hi - lo) * bins), bins - 1) AS b, count(*) AS c FROM e JOIN m USING (series) GROUP BY ALL) SELECT series, bins, round(-sum(c / n * ln(c / n + 1e-9)), 6) AS entropy FROM c GROUP BY series, bins",
)
_add(
    "correlation_matrix", lambda s, f: rounded(T.correlation_matrix(line_series(s, f), ["q", "v", "d", "t"])),
    f"WITH {L} " + " UNION ALL ".join(f"SELECT series, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM l GROUP BY series" for i, a in enumerate("qvdt") for b in "qvdt"[i + 1 :]),
)
_add(
    "jarque_bera", lambda s, f: rounded(T.jarque_bera(events_series(s, f), "x"), 4),
    f"WITH {E} SELECT series, count(x) AS n, round(count(x) * ({_skew('x')} ** 2 / 6 + kurtosis_pop(x) ** 2 / 24), 4) AS jb FROM e GROUP BY series",
)
_add("adf_test", lambda s, f: rounded(T.adf_test(events_series(s, f), "x")))
_add("adf_batch", lambda s, f: rounded(T.adf_batch(line_series(s, f), ["q", "d"])))
_add("feature_profile", lambda s, f: rounded(T.feature_profile(events_series(s, f), "x")))
_rolled = ", ".join(f"round({f}(x) OVER {_w(k)}, 9) AS rolling_{n}_{k}" for k in (20, 50, 100) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
_moved = ", ".join(f"round(x - avg(x) OVER {_w(k)}, 9) AS cycle_{k}" for k in (20, 50, 100))
_low = "min(x) OVER (PARTITION BY series)"
_still = ", ".join(f"round({f}(x + CASE WHEN {_low} <= 0 THEN abs({_low}) + 1e-8 ELSE 1e-8 END), 9) AS stabilised_{n}" for n, f in (("log", "ln"), ("sqrt", "sqrt")))
_add("feature_columns", lambda s, f: rounded(T.feature_columns(events_series(s, f).select("series", "idx", "x"), "x").drop("x"), 9), f"WITH {E} SELECT series, idx, {_rolled}, {_moved}, {_still} FROM e")
