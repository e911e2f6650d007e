"""Queries of joins, sets, quality gates, the model registry and the run log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from serieslab.core import shared_dir, table
from serieslab.operators import columns as K
from serieslab.operators import registry as G
from serieslab.operators import relations as J
from serieslab.plans.frames import E, events_series, rounded
from serieslab.sources import files as I

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, made, sql: str | None = None) -> None:
    QUERIES[name] = made
    if sql:
        ORACLE_SQL[name] = sql


# joins and sets
def _means(s, f):
    return table(s, f, "events").groupBy(F.col("event_type").alias("series"), "user_id").agg(F.avg("value").alias("m"))


_add("attach_features", lambda s, f: rounded(J.attach_features(events_series(s, f), _means(s, f), ["series", "user_id"]).select("event_id", "m")), "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type, user_id), 6) AS m FROM events")
_add("attach_by_position", lambda s, f: rounded(J.attach_by_position(*(lambda d: (d.select("series", "idx", "x"), d.where("idx % 2 = 0").select("series", "idx", "event_id")))(events_series(s, f)))), f"WITH {E} SELECT series, idx, round(x, 6) AS x, event_id FROM e WHERE idx % 2 = 0")
_add("reindex_to", lambda s, f: rounded((lambda d: J.reindex_to(d.where("idx % 3 = 0").select("series", "idx", "x"), d))(events_series(s, f))), f"WITH {E} SELECT series, idx, CASE WHEN idx % 3 = 0 THEN round(x, 6) END AS x FROM e")
_add("broadcast_scalars", lambda s, f: rounded((lambda d: J.broadcast_scalars(d.select("series", "idx"), d.groupBy("series").agg(F.max("x").alias("top"))))(events_series(s, f))), f"WITH {E} SELECT series, idx, round(max(x) OVER (PARTITION BY series), 6) AS top FROM e")
_add("feature_pairs", lambda s, f: J.feature_pairs(table(s, f, "part").select(F.col("p_brand").alias("feature")).distinct()), "WITH f AS (SELECT DISTINCT p_brand AS feature FROM part) SELECT a.feature AS a, b.feature AS b FROM f a JOIN f b ON a.feature < b.feature")
_add(
    "union_parts", lambda s, f: J.union_parts([table(s, f, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a")), table(s, f, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))]),
    "SELECT c_custkey AS k, c_acctbal AS a, NULL::VARCHAR AS n FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier",
)
_add("new_columns", lambda s, f: J.new_names(table(s, f, "supplier").select(F.col("s_nationkey").alias("name")), table(s, f, "customer").select(F.col("c_nationkey").alias("name")).distinct()), "SELECT DISTINCT c_nationkey AS name FROM customer EXCEPT SELECT s_nationkey FROM supplier")
_add("top_k", lambda s, f: J.top_k(table(s, f, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_add("top_k_per_group", lambda s, f: J.top_k_per_group(table(s, f, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus", "o_totalprice", 5, "o_orderkey"), "SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place FROM (SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders) QUALIFY place <= 5")
_add("pick_best_per_category", lambda s, f: J.pick_best_per_category(table(s, f, "part"), "p_brand", "p_name", "p_retailprice"), "SELECT p_brand, first(p_name ORDER BY p_retailprice DESC, p_name) AS best FROM part GROUP BY p_brand")
_add("skip_done", lambda s, f: J.skip_done(table(s, f, "customer").select(F.col("c_custkey").alias("k")), table(s, f, "orders").select(F.col("o_custkey").alias("k")), "k"), "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
# quality
_add("drop_denied", lambda s, f: K.drop_denied(table(s, f, "part"), ["p_type"], ["p_b"], ["p_brand"]), "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
_add("drop_metric_columns", lambda s, f: K.drop_denied(table(s, f, "part"), [], ["p_t", "p_n"]), "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
_add("drop_constant", lambda s, f: K.drop_constant(table(s, f, "nation").withColumn("one", F.lit(1)), ["n_nationkey", "n_regionkey", "one"]), "SELECT n_nationkey, n_name, n_regionkey FROM nation")


def _gaps(s, f):
    return events_series(s, f).withColumn("y", F.when(F.col("event_id") % 7 < 2, F.lit(None)).when(F.col("event_id") % 7 == 2, F.lit(float("nan"))).when(F.col("event_id") % 7 == 3, F.lit(float("inf"))).otherwise(F.col("x")))


_y = "CASE WHEN event_id % 7 >= 4 THEN x END"
_add("drop_incomplete_rows", lambda s, f: rounded(K.drop_incomplete_rows(_gaps(s, f), ["y"]).select("event_id", "y")), f"WITH {E} SELECT event_id, round(x, 6) AS y FROM e WHERE event_id % 7 >= 4")
_add("ffill", lambda s, f: rounded(K.ensure_finite(_gaps(s, f), ["y"], 0.0).select("series", "idx", "y")), f"WITH {E} SELECT series, idx, round(coalesce(last_value({_y} IGNORE NULLS) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS y FROM e")
_add(
    "fill_both_ways", lambda s, f: rounded(K.fill_both_ways(_gaps(s, f).withColumn("y", F.when(F.col("event_id") % 7 >= 4, F.col("x"))), ["y"]).select("series", "idx", "y")),
    f"WITH {E} SELECT series, idx, round(coalesce(last_value({_y} IGNORE NULLS) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({_y} IGNORE NULLS) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS y FROM e",
)
_add("impute", lambda s, f: rounded(K.impute(_gaps(s, f).withColumn("y", F.when(F.col("event_id") % 7 >= 4, F.col("x"))), ["y"]).select("series", "idx", "y")), f"WITH {E} SELECT series, idx, round(coalesce({_y}, median({_y}) OVER (PARTITION BY series)), 6) AS y FROM e")
_add("null_inf_report", lambda s, f: rounded(K.null_inf_report(_gaps(s, f), ["x", "y"])), f"WITH {E} SELECT 'x' AS feature, 0.0::DOUBLE AS null_pct, 0::BIGINT AS inf_count, false AS flagged UNION ALL SELECT 'y', round(avg((event_id % 7 < 2)::INTEGER) * 100, 6), count(*) FILTER (event_id % 7 = 3), avg((event_id % 7 < 2)::INTEGER) > 0.5 FROM e")
_flat = lambda k: f"(coalesce(CASE WHEN count(x) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) >= {max(3, k // 2)} THEN stddev_samp(x) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END, 0) < 1e-8)::INTEGER AS f{k}"
_add(
    "series_quality", lambda s, f: rounded(K.series_quality(events_series(s, f), "x")),
    f"WITH {E}, w AS (SELECT *, {_flat(10)}, {_flat(20)}, {_flat(50)}, avg(x) OVER (PARTITION BY series) AS m, stddev_samp(x) OVER (PARTITION BY series) AS s FROM e), g AS (SELECT series, count(*) AS n, 0.0::DOUBLE AS missing_pct, greatest(avg(f10), avg(f20), avg(f50)) AS flat_share, avg((abs(x - m) > 3 * s)::INTEGER) AS outlier_share FROM w GROUP BY series) "
    "SELECT series, n, missing_pct, round(flat_share, 6) AS flat_share, round(outlier_share, 6) AS outlier_share, n >= 100 AND flat_share < 0.8 AND outlier_share < 0.2 AS passed FROM g",
)
_add("stage_delta", lambda s, f: (lambda d: K.stage_delta(d, d.where("o_totalprice > 100000").withColumn("big", F.lit(True))))(table(s, f, "orders")), "SELECT count(*) AS rows_before, count(*) FILTER (o_totalprice > 100000) AS rows_after, 6 AS cols_before, 7 AS cols_after, 'big' AS new_cols FROM orders")
_stats = lambda s, f: table(s, f, "orders").groupBy(F.col("o_custkey").alias("stage")).agg(F.count("*").alias("features"), F.lit(10).alias("expected"), (F.avg((F.col("o_totalprice") < 100000).cast("double")) * 100).alias("null_pct"), F.max("o_totalprice").alias("seconds"), F.lit(200000.0).alias("usual"))
_add(
    "data_alerts", lambda s, f: K.data_alerts(_stats(s, f)),
    "WITH m AS (SELECT o_custkey AS stage, count(*) AS features, avg((o_totalprice < 100000)::INTEGER) * 100 AS null_pct, max(o_totalprice) AS seconds FROM orders GROUP BY 1) SELECT stage, 'features' AS alert FROM m WHERE abs(features - 10) > 5 UNION ALL SELECT stage, 'nulls' FROM m WHERE null_pct > 50 UNION ALL SELECT stage, 'slow' FROM m WHERE seconds > 300000",
)
_add("validate_schema", lambda s, f: K.validate_schema(table(s, f, "part"), {"p_partkey": "bigint", "p_size": "double", "p_color": "string"}), "SELECT * FROM (VALUES ('warning', 'p_size', 'int instead of double'), ('error', 'p_color', 'missing')) v(level, \"column\", message)")
_add(
    "leakage_guard", lambda s, f: K.leakage_guard(table(s, f, "part").select("p_partkey", F.concat(F.element_at(F.array(*[F.lit(x) for x in ("y_ret_fwd_", "dcor_", "y_", "adf_")]), (F.col("p_partkey") % 4 + 1).cast("int")), "p_brand").alias("feature"))),
    "SELECT p_partkey, (['y_ret_fwd_', 'dcor_', 'y_', 'adf_'])[p_partkey % 4 + 1] || p_brand AS feature, p_partkey % 4 <> 2 AS leaks FROM part",
)
_add("candidate_features", lambda s, f: (lambda d: d.select(*K.candidate_features(d)))(table(s, f, "part").select(F.col("p_size").alias("y_size"), F.col("p_name").alias("y_name"), F.col("p_retailprice").alias("x_price"), F.col("p_partkey").alias("y_ret_fwd_5m"))), "SELECT p_size AS y_size, p_retailprice AS x_price FROM part")
_add("eligible_float_columns", lambda s, f: (lambda d: d.select(*K.eligible_float_columns(d)))(table(s, f, "customer")), "SELECT c_acctbal FROM customer")
_ROLES = [("price", "y_close_"), ("return", "y_ret_"), ("volume", "y_tick_volume_"), ("volatility", "y_rv_"), ("spread", "y_spread_"), ("ofi", "y_ofi_"), ("target", "y_ret_fwd_"), ("metric", "dcor_")]


def _by_brand(s, f):
    """A column for each brand and kind of feature that the parts name."""
    kind = F.element_at(F.array(*[F.lit(n) for _, n in _ROLES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(s, f, "part").select("p_size", F.concat(kind, "p_brand").alias("name")).groupBy().pivot("name").agg(F.avg("p_size"))


_add("columns_by_role", lambda s, f: (lambda d: s.createDataFrame([(r, c) for r, cs in K.columns_by_role(d).items() for c in cs], "role string, name string"))(_by_brand(s, f)),
     f"SELECT DISTINCT ({[r for r, _ in _ROLES]})[p_partkey % 8 + 1] AS role, ({[n for _, n in _ROLES]})[p_partkey % 8 + 1] || p_brand AS name FROM part")
_add("table_info", lambda s, f: I.table_info(table(s, f, "nation")).select("column", "type", "files", "megabytes"))
_add("discover_series", lambda s, f: I.discover_series(s, f))
_add("scan_parquet", lambda s, f: I.scan_parquet(s, f"{f}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")

_add(
    "scan_object_store", lambda s, f: I.scan_object_store(s, f"{f if '://' in f else 'file://' + f}/orders.parquet", ["o_orderkey", "o_totalprice"], split_bytes=8 << 20).where("o_totalprice > 1000"),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000",
)


def _store(s, f) -> str:
    """A store with facts of a model for each priority and status of orders."""
    root = f"{shared_dir(s)}/models-{uuid.uuid4().hex}"
    facts = table(s, f, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("model")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    facts.write.partitionBy("symbol", "model").parquet(f"{root}/meta")
    return root


def _after_deletion(s, f):
    root = _store(s, f)
    I.delete_stored(s, root, "1-URGENT", "O")
    return I.stored_files(s, root).select("symbol", "model").distinct()


_add("delete_stored", _after_deletion, "SELECT DISTINCT o_orderpriority AS symbol, o_orderstatus AS model FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')")


# registry: orders are models, lineitem their features
def _models(s, f):
    return table(s, f, "orders").select(F.col("o_orderkey").alias("model_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("timeframe"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 5).cast("int").alias("version"), (F.col("o_orderkey") % 3 == 0).alias("is_active"))


def _features(s, f):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return table(s, f, "lineitem").select(F.col("l_orderkey").alias("model_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("feature"), F.col("l_extendedprice").alias("importance"), F.row_number().over(w).alias("rank"))


def _metrics(s, f):
    return table(s, f, "orders").select(F.col("o_orderkey").alias("model_id"), F.explode(F.create_map(F.lit("r2"), F.col("o_totalprice") / 1e6, F.lit("mse"), F.col("o_totalprice") / 7)).alias("metric", "value"))


_M = "models AS (SELECT o_orderkey AS model_id, o_orderpriority AS symbol, o_orderstatus AS timeframe, o_totalprice AS score, (o_orderkey % 5)::INTEGER AS version, o_orderkey % 3 = 0 AS is_active FROM orders)"
_F = "feats AS (SELECT l_orderkey AS model_id, 'f' || l_partkey AS feature, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity) AS rank FROM lineitem)"
_top = "top AS (SELECT model_id, string_agg(feature, ',' ORDER BY rank) AS top_features FROM feats WHERE rank <= 3 GROUP BY model_id)"
_add("list_models", lambda s, f: G.list_models(_models(s, f)), f"WITH {_M} SELECT * FROM models WHERE is_active")
_add(
    "model_details", lambda s, f: rounded(G.model_details(_models(s, f), _features(s, f), _metrics(s, f), 7)),
    f"WITH {_M}, {_F} SELECT m.model_id, symbol, timeframe, score, version, is_active, string_agg(feature, ',' ORDER BY rank) AS features, 'mse,r2' AS metrics FROM models m LEFT JOIN feats f ON f.model_id = m.model_id WHERE m.model_id = 7 GROUP BY ALL",
)
_add(
    "compare_models", lambda s, f: rounded(G.compare_models(_models(s, f), _features(s, f), _metrics(s, f), ["mse", "r2"], 3)),
    f"WITH {_M}, {_F}, {_top} SELECT models.*, top_features, round(score / 7, 6) AS mse, round(score / 1e6, 6) AS r2 FROM models LEFT JOIN top USING (model_id)",
)
_add(
    "performance_summary", lambda s, f: rounded(G.performance_summary(_models(s, f), _features(s, f), _metrics(s, f), ["r2"], 3)),
    f"WITH {_M}, {_F}, {_top}, n AS (SELECT model_id, count(*) AS n_features FROM feats GROUP BY model_id) SELECT models.*, top_features, round(score / 1e6, 6) AS r2, n_features FROM models LEFT JOIN top USING (model_id) LEFT JOIN n USING (model_id)",
)
_add("rank_models", lambda s, f: rounded(G.rank_models(_metrics(s, f), _models(s, f), "r2")), f"WITH {_M} SELECT model_id, symbol, round(score / 1e6, 6) AS value, rank() OVER (PARTITION BY symbol ORDER BY score / 1e6 DESC)::INTEGER AS place FROM models")
_add(
    "register_model", lambda s, f: (lambda m: G.register_model(m.where("model_id % 2 = 0"), m.where("model_id % 2 = 1").drop("version"), ["symbol", "timeframe"]))(_models(s, f).drop("is_active", "score")),
    f"WITH {_M}, o AS (SELECT model_id, symbol, timeframe, version FROM models WHERE model_id % 2 = 0), t AS (SELECT symbol, timeframe, max(version) AS top FROM o GROUP BY ALL), a AS (SELECT model_id, symbol, timeframe, (coalesce(top, 0) + row_number() OVER (PARTITION BY symbol, timeframe ORDER BY model_id))::INTEGER AS version FROM models LEFT JOIN t USING (symbol, timeframe) WHERE model_id % 2 = 1), "
    "u AS (SELECT * FROM o UNION ALL SELECT * FROM a) SELECT *, version = max(version) OVER (PARTITION BY symbol, timeframe) AS is_active FROM u",
)
_add("delete_model", lambda s, f: G.delete_model(_models(s, f), table(s, f, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("model_id"))), f"WITH {_M} SELECT * FROM models WHERE model_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
_add("storage_stats", lambda s, f: rounded(G.storage_stats(table(s, f, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("modified"))), 2), "SELECT o_orderpriority AS symbol, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, max(o_orderdate) AS latest FROM orders GROUP BY 1")
_add("feature_overlap", lambda s, f: J.feature_overlap(table(s, f, "lineitem").select(F.col("l_returnflag").alias("model_id"), F.col("l_partkey").alias("feature"))), "SELECT l_partkey AS feature, count(DISTINCT l_returnflag) AS models, count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS in_all FROM lineitem GROUP BY 1")
# run log: events are status rows
_S = "s AS (SELECT event_id AS id, user_id AS task, (['PENDING', 'RUNNING', 'COMPLETED', 'FAILED'])[event_id % 4 + 1] AS status, ts AS \"at\" FROM events)"


def _status(s, f):
    names = F.array(*[F.lit(x) for x in ("PENDING", "RUNNING", "COMPLETED", "FAILED")])
    return table(s, f, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task"), F.get(names, (F.col("event_id") % 4).cast("int")).alias("status"), F.col("ts").alias("at"))


_add("latest_status", lambda s, f: G.latest_status(_status(s, f)), f"WITH {_S} SELECT task, status, \"at\" FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY \"at\" DESC, id DESC) = 1")
_add(
    "pending_tasks", lambda s, f: G.pending_tasks(table(s, f, "customer").select(F.col("c_custkey").alias("task"), F.col("c_acctbal").alias("added")), _status(s, f), F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")),
    f"WITH {_S}, l AS (SELECT task, status, \"at\" FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY \"at\" DESC, id DESC) = 1) SELECT c_custkey AS task, c_acctbal AS added, status FROM customer LEFT JOIN l ON task = c_custkey WHERE status IS NULL OR status IN ('PENDING', 'FAILED') OR (status = 'RUNNING' AND \"at\" < TIMESTAMP '2024-01-29 11:00:00')",
)
_add(
    "upsert_task", lambda s, f: (lambda d: G.upsert(d.where("id % 2 = 0"), d.where("id % 2 = 1"), "task", "id"))(_status(s, f)),
    f"WITH {_S} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY id DESC) = 1",
)
_add(
    "stage_events", lambda s, f: G.stage_events(table(s, f, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("stage"), F.get(F.array(F.lit("START"), F.lit("END"), F.lit("ERROR")), (F.col("event_id") % 3).cast("int")).alias("status"), F.col("ts").alias("at"))),
    "SELECT user_id AS task, event_type AS stage, min(ts) FILTER (event_id % 3 = 0) AS started, max(ts) FILTER (event_id % 3 = 1) AS ended, count(*) FILTER (event_id % 3 = 2) AS errors FROM events GROUP BY ALL",
)
_add("stage_metrics", lambda s, f: G.stage_metrics(table(s, f, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("value_text"))), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS value_text, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS value_float FROM part")
_add("metric_category", lambda s, f: table(s, f, "part").select("p_partkey", F.element_at(F.array(F.lit("train_r2"), F.lit("test_mse"), F.lit("rmse"), F.lit("names")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("metric")).withColumn("category", G.metric_category("metric")), "SELECT p_partkey, (['train_r2', 'test_mse', 'rmse', 'names'])[p_partkey % 4 + 1] AS metric, (['training', 'test', 'regression', 'other'])[p_partkey % 4 + 1] AS category FROM part")


_add(
    "register_features", lambda s, f: G.ranked_features(table(s, f, "lineitem").select(F.col("l_orderkey").alias("model_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("feature"), F.col("l_extendedprice").alias("selection_importance"), F.col("l_quantity").alias("final_importance"))),
    "WITH r AS (SELECT l_orderkey AS model_id, 'f' || l_linenumber || '_' || l_partkey AS feature, l_extendedprice AS selection_importance, l_quantity AS final_importance FROM lineitem) SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY selection_importance DESC, feature)::INTEGER AS rank_selection, row_number() OVER (PARTITION BY model_id ORDER BY final_importance DESC, feature)::INTEGER AS rank_final FROM r",
)
_add(
    "register_metrics", lambda s, f: rounded(G.finite_metrics(_metrics(s, f).withColumn("value", F.when(F.col("model_id") % 5 == 0, F.lit(float("nan"))).when(F.col("model_id") % 5 == 1, F.lit(None)).otherwise(F.col("value"))))),
    f"WITH {_M}, k AS (SELECT model_id, 'r2' AS metric, score / 1e6 AS value FROM models UNION ALL SELECT model_id, 'mse', score / 7 FROM models) SELECT model_id, metric, round(value, 6) AS value, 'regression' AS category FROM k WHERE model_id % 5 > 1",
)
_event = "(['START', 'END', 'ERROR', 'NOTE', 'NOTE'])[event_id % 5 + 1]"


def _runs(s, f):
    names = F.array(*[F.lit(x) for x in ("START", "END", "ERROR", "NOTE", "NOTE")])
    return table(s, f, "events").select((F.col("event_id") % 211).alias("run_id"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("event"), F.col("ts").alias("at"))


_add(
    "run_log", lambda s, f: G.run_log(_runs(s, f)),
    f"WITH r AS (SELECT event_id % 211 AS run_id, {_event} AS event, ts FROM events) SELECT run_id, min(ts) FILTER (event = 'START') AS started, max(ts) FILTER (event = 'END') AS ended, "
    "CASE WHEN count(*) FILTER (event = 'ERROR') > 0 THEN 'FAILED' WHEN count(*) FILTER (event = 'END') > 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM r GROUP BY run_id",
)
_add(
    "artifacts", lambda s, f: G.latest_artifacts(table(s, f, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 2 == 0, "table").otherwise("plot").alias("kind"), F.concat(F.lit("out/"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("at"))),
    "SELECT user_id AS task, event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'table' ELSE 'plot' END AS kind, arg_max('out/' || event_id, (ts, 'out/' || event_id)) AS path, count(*) AS n FROM events GROUP BY ALL",
)
_add(
    "task_info", lambda s, f: G.task_info(table(s, f, "customer").select(F.col("c_custkey").alias("task"), "c_name"), _status(s, f)),
    f"WITH {_S}, l AS (SELECT task, status, \"at\" FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY \"at\" DESC, id DESC) = 1) SELECT c_custkey AS task, c_name, status, \"at\", coalesce(status = 'COMPLETED', false) AS processed FROM customer LEFT JOIN l ON task = c_custkey",
)


# written tables read again
def _written(s, f):
    path = f"{shared_dir(s)}/features-{uuid.uuid4().hex}"
    I.write_features(events_series(s, f).select("series", "idx", "x", F.lit(1.0).alias("dcor_x")), path, ("dcor_",))
    return rounded(s.read.parquet(path))


def _staged(s, f):
    return rounded(I.checkpoint_stage(events_series(s, f).select("series", "idx", "x"), f"{shared_dir(s)}/stages-{uuid.uuid4().hex}", "first"))


def _scores(s, f):
    path = f"{shared_dir(s)}/scores-{uuid.uuid4().hex}"
    I.write_scores(table(s, f, "part").select(F.concat("p_brand", F.lit("_"), F.col("p_partkey").cast("string")).alias("feature"), F.col("p_retailprice").alias("score")), path)
    return rounded(s.read.schema("feature string, score double").json(path))


_add("write_features", _written, f"WITH {E} SELECT series, idx, round(x, 6) AS x FROM e")
_add("checkpoint_stage", _staged, f"WITH {E} SELECT series, idx, round(x, 6) AS x FROM e")
_add("write_scores", _scores, "SELECT p_brand || '_' || p_partkey AS feature, round(p_retailprice, 6) AS score FROM part ORDER BY p_retailprice DESC, 1 LIMIT 200")
