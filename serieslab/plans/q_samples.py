"""Queries of samples, splits, labels and session masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieslab.operators import labels as B
from serieslab.operators import sampling as P
from serieslab.plans.frames import E, L, events_series, line_series, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_o = "OVER (PARTITION BY series ORDER BY idx)"
_n = "n AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM e)"


def _add(name: str, made, sql: str | None = None) -> None:
    QUERIES[name] = made
    if sql:
        ORACLE_SQL[name] = sql


def _events(made, *columns: str, places: int = 6):
    return lambda spark, sf: rounded(made(events_series(spark, sf)).select(*columns), places)


_add("sort_series", lambda s, f: P.ordered_by(s.read.parquet(f"{f}/events.parquet").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "place"), "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events")
_add("head_sample", _events(lambda d: P.head_sample(d, 100), "series", "idx", "x"), f"WITH {E} SELECT series, idx, round(x, 6) AS x FROM e WHERE idx < 100")
_add("tail_sample", _events(lambda d: P.tail_sample(d, 100), "series", "idx", "x"), f"WITH {E}, {_n} SELECT series, idx, round(x, 6) AS x FROM n WHERE idx >= n - 100")
_add(
    "systematic_sample", _events(lambda d: P.systematic_sample(d, 37), "series", "idx", "x"),
    f"WITH {E}, {_n}, j AS (SELECT unnest(range(37)) AS j), k AS (SELECT DISTINCT series, CASE WHEN n <= 37 THEN j ELSE j * (n - 1) // 36 END AS idx FROM (SELECT DISTINCT series, n FROM n), j) SELECT series, idx, round(x, 6) AS x FROM n SEMI JOIN k USING (series, idx)",
)
_add(
    "stratified_sample", lambda s, f: P.stratified_sample(line_series(s, f), "flag", 500).select("idx", "flag"),
    f"WITH {L}, c AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY idx) - 1 AS place, count(*) OVER (PARTITION BY flag) AS m, count(*) OVER () AS n FROM l), "
    "q AS (SELECT DISTINCT flag, m, least(greatest(1, floor(m * 500 / n + 0.5)), m)::BIGINT AS q FROM c), k AS (SELECT DISTINCT flag, CASE WHEN q = 1 THEN 0 ELSE j * (m - 1) // (q - 1) END AS place FROM (SELECT flag, m, q, unnest(range(q)) AS j FROM q)) SELECT idx, flag FROM c SEMI JOIN k USING (flag, place)",
)
_add("time_split", _events(lambda d: P.time_split(d), "series", "idx", "split"), f"WITH {E}, {_n} SELECT series, idx, CASE WHEN idx < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM n")
_add(
    "random_split", _events(lambda d: P.random_split(d, ["event_id"]), "series", "idx", "split"),
    f"WITH {E} SELECT series, idx, CASE WHEN ('0x' || substr(md5(event_id || '|42'), 1, 8))::BIGINT % 1000 < 200 THEN 'test' ELSE 'train' END AS split FROM e",
)
_add(
    "expanding_splits", _events(lambda d: P.expanding_splits(d, 5, 50), "series", "idx", "fold", "role"),
    f"WITH {E}, {_n}, f AS (SELECT *, unnest(range(5))::INTEGER AS fold, n // 6 AS size FROM n), g AS (SELECT *, n - (5 - fold) * size AS start FROM f) "
    "SELECT series, idx, fold, CASE WHEN idx < start THEN 'train' ELSE 'test' END AS role FROM g WHERE start >= 50 AND size >= 10 AND idx < start + size",
)


def _role(start: str, stop: str, purge: int, embargo: int) -> str:
    return f"CASE WHEN idx >= {start} AND idx < {stop} THEN 'test' WHEN idx >= {start} - {purge} AND idx < {stop} + {purge + embargo} THEN 'purged' ELSE 'train' END"


_start = lambda g, k: f"(({g}) * (n // {k}) + least({g}, n % {k}))"
_add(
    "purged_kfold", _events(lambda d: P.purged_kfold(d, 5, 20, 30), "series", "idx", "fold", "role"),
    f"WITH {E}, {_n}, f AS (SELECT *, unnest(range(5))::INTEGER AS fold FROM n) SELECT series, idx, fold, {_role(_start('fold', 5), _start('fold + 1', 5), 20, 30)} AS role FROM f",
)


def _cpcv(span: bool, k: int = 6, purge: int = 20, embargo: int = 30) -> str:
    a, b = (_role(_start(g, k), _start(g + " + 1", k), purge, embargo) for g in ("a", "b"))
    gone = f"idx >= {_start('a', k)} - {purge} AND idx < {_start('b + 1', k)} + {purge + embargo}" if span else f"{a} = 'purged' OR {b} = 'purged'"
    return (
        f"WITH {E}, {_n}, c AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INTEGER AS combo, a, b FROM (SELECT unnest(range({k})) AS a), (SELECT unnest(range({k})) AS b) WHERE a < b) "
        f"SELECT series, idx, combo, CASE WHEN {a} = 'test' OR {b} = 'test' THEN 'test' WHEN {gone} THEN 'purged' ELSE 'train' END AS role FROM n, c"
    )


_add("cpcv_splits", _events(lambda d: P.cpcv_splits(d, 6, 2, 20, 30), "series", "idx", "combo", "role"), _cpcv(False))
_add("cpcv_splits_span", _events(lambda d: P.cpcv_splits(d, 6, 2, 20, 30, True), "series", "idx", "combo", "role"), _cpcv(True))
_bits = lambda r: f"sum(CASE WHEN role = '{r}' THEN 1::BIGINT << combo ELSE 0 END)::BIGINT AS {r}_bits"
_add(
    "fold_bits", _events(lambda d: P.fold_bits(d, P.cpcv_roles()), "series", "idx", "train_bits", "test_bits", "purged_bits"),
    f"SELECT series, idx, {_bits('train')}, {_bits('test')}, {_bits('purged')} FROM ({_cpcv(False, 10, 50, 100)}) GROUP BY ALL",
)
# labels
_add("forward_log_return", _events(lambda d: B.forward_log_return(d, "x", 10), "series", "idx", "y"), f"WITH {E} SELECT series, idx, round(CASE WHEN x > 0 AND lead(x, 10) {_o} > 0 THEN ln(lead(x, 10) {_o} / x) END, 6) AS y FROM e")
_add("direction_label", _events(lambda d: B.direction_label(d, "x", 5), "series", "idx", "label"), f"WITH {E}, a AS (SELECT *, lead(x, 5) {_o} AS a FROM e) SELECT series, idx, (a > x)::INTEGER AS label FROM a WHERE a IS NOT NULL")


def _barrier(tp: float, sl: float, limit: int, least: int = 5) -> str:
    return (
        f"p AS (SELECT *, list(x) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN {least} FOLLOWING AND {limit} FOLLOWING) AS p, lead(x, {limit + least}) {_o} AS far FROM e), "
        f"u AS (SELECT *, list_min(list_filter(range(1, len(p) + 1), lambda i: p[i] >= x * (1 + {tp!r}))) AS u, list_min(list_filter(range(1, len(p) + 1), lambda i: p[i] <= x * (1 - {sl!r}))) AS d FROM p WHERE far IS NOT NULL), "
        f"b AS (SELECT series, idx, x, (CASE WHEN u IS NOT NULL AND u <= coalesce(d, 1000000) THEN 1 WHEN d IS NOT NULL THEN -1 ELSE 0 END)::INTEGER AS label, (coalesce(least(u, d), len(p)) - 1 + {least})::INTEGER AS periods, p[coalesce(least(u, d), len(p))] / nullif(x, 0) - 1 AS ret FROM u)"
    )


_add("triple_barrier", _events(lambda d: B.triple_barrier(d, "x", 0.2, 0.1, 30), "series", "idx", "label", "periods", "ret"), f"WITH {E}, {_barrier(0.2, 0.1, 30)} SELECT series, idx, label, periods, round(ret, 6) AS ret FROM b")
_add(
    "label_summary", lambda s, f: rounded(B.label_summary(B.triple_barrier(events_series(s, f), "x", 0.2, 0.1, 30), ["series"]), 4),
    f"WITH {E}, {_barrier(0.2, 0.1, 30)}, w AS (SELECT series, count(*) AS m, avg(ret) AS expected, avg((label = 1)::INTEGER) AS win_rate FROM b GROUP BY series), g AS (SELECT series, label, count(*) AS n, avg(periods) AS periods, avg(ret) AS ret FROM b GROUP BY ALL) "
    "SELECT series, label, n, round(n / m, 4) AS share, round(periods, 4) AS periods, round(ret, 4) AS ret, round(expected, 4) AS expected, round(win_rate, 4) AS win_rate, round(win_rate * 100 * expected * 1000, 4) AS score FROM g JOIN w USING (series)",
)
_sweep = " UNION ALL ".join(f"SELECT series, '{n}' AS name, n, win_rate, expected FROM (WITH {_barrier(tp, sl, k)} SELECT series, count(*) AS n, avg((label = 1)::INTEGER) AS win_rate, avg(ret) AS expected FROM b GROUP BY series)" for n, tp, sl, k in B.BARRIERS)
_add("barrier_sweep", lambda s, f: rounded(B.barrier_sweep(events_series(s, f), "x"), 4), f"WITH {E}, s AS ({_sweep}) SELECT series, name, n, round(win_rate, 4) AS win_rate, round(expected, 4) AS expected, round(win_rate * 100 * expected * 1000, 4) AS score FROM s")
_q = lambda x: f"quantile_cont({x}, [0.001, 0.999])"
_sig = "CASE WHEN count(x) OVER w >= 10 THEN stddev_samp(x) OVER w END"
_add(
    "vol_scale", _events(lambda d: B.vol_scaled(d, "x", 50), "series", "idx", "sigma", "scaled", "weight", places=5),
    f"WITH {E}, s AS (SELECT series, idx, x, greatest(coalesce({_sig}, stddev_samp(x) OVER (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING), 1e-6), 1e-6) AS sigma FROM e WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), "
    f"q AS (SELECT series, {_q('x / sigma')} AS q FROM s GROUP BY series) SELECT series, idx, round(sigma, 5) AS sigma, round(least(greatest(x / sigma, q[1]), q[2]), 5) AS scaled, round(1 / sigma, 5) AS weight FROM s JOIN q USING (series)",
)
_add("winsorise", _events(lambda d: B.winsorised(d, "x", 0.05, 0.95), "series", "idx", "w"), f"WITH {E}, q AS (SELECT series, quantile_cont(x, [0.05, 0.95]) AS q FROM e GROUP BY series) SELECT series, idx, round(least(greatest(x, q[1]), q[2]), 6) AS w FROM e JOIN q USING (series)")
_add(
    "task_type", lambda s, f: B.task_type(s.read.parquet(f"{f}/lineitem.parquet").select(F.col("l_returnflag").alias("series"), F.col("l_linenumber").cast("double").alias("y")), "y"),
    "SELECT l_returnflag AS series, count(DISTINCT l_linenumber) AS distinct_values, CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN 'classification' ELSE 'regression' END AS task FROM lineitem GROUP BY 1",
)
#: A short calendar: (driver, weekday, start_min, end_min) and holidays.
SCHEDULE = [("spx", d, 810, 1200) for d in range(5)] + [("dxy", d, 0, 1440) for d in range(5)] + [("brent", d, 60, 1380) for d in range(5)]
HOLIDAYS = [("spx", "2024-01-15")]
_values = ", ".join(map(str, SCHEDULE))


def _calendar(spark):
    days = spark.createDataFrame(HOLIDAYS, "driver string, d string").select("driver", F.to_date("d").alias("date"))
    return spark.createDataFrame(SCHEDULE, "driver string, weekday int, start_min int, end_min int"), days


_in = "EXISTS (SELECT 1 FROM s WHERE s.driver = 'spx' AND s.weekday = isodow(ts) - 1 AND hour(ts) * 60 + minute(ts) >= s.start_min AND hour(ts) * 60 + minute(ts) < s.end_min) AND ts::DATE <> DATE '2024-01-15'"
_sched = f"s(driver, weekday, start_min, end_min) AS (VALUES {_values})"
_add("session_mask", lambda s, f: B.session_mask(events_series(s, f), "ts", *_calendar(s), "spx").select("event_id", "open"), f"WITH {_sched} SELECT event_id, {_in} AS open FROM events")
_add(
    "driver_mask", lambda s, f: B.driver_mask(events_series(s, f).withColumn("flag", F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 8 == 0)), "ts", "flag", *_calendar(s), "spx").select("event_id", "open"),
    f"WITH {_sched} SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END, {_in}) AS open FROM events",
)
_map = [("dxy", "dxy"), ("spx", "spx"), ("dx", "short"), ("brent", "brent")]
_add(
    "driver_of", lambda s, f: B.driver_of(s.read.parquet(f"{f}/part.parquet").select(F.concat(F.element_at(F.array(F.lit("dxy_"), F.lit("SPX_"), F.lit("dx_"), F.lit("none_")), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_brand")).alias("feature")).distinct(), s.createDataFrame(_map, "substring string, driver string")),
    "WITH f AS (SELECT DISTINCT (['dxy_', 'SPX_', 'dx_', 'none_'])[p_partkey % 4 + 1] || p_brand AS feature FROM part), " + f"m(substring, driver) AS (VALUES {', '.join(map(str, _map))}) SELECT feature, max_by(driver, length(substring)) AS driver FROM f LEFT JOIN m ON contains(lower(feature), substring) GROUP BY feature",
)
_add(
    "coverage_mask", lambda s, f: B.coverage_mask(events_series(s, f).withColumn("y", F.when(F.col("event_id") % 3 != 0, F.col("x"))), ["x", "y"], 24, 18).select("series", "idx", "covered_x", "covered_y"),
    f"WITH {E} SELECT series, idx, count(x) OVER w >= 18 AS covered_x, count(CASE WHEN event_id % 3 <> 0 THEN x END) OVER w >= 18 AS covered_y FROM e WINDOW w AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)",
)
