"""How the operators' inputs are bound to the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.core import finite, materialise, table, with_row_index, with_scalars

#: events as one series for each event type.
E = """e AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS x, ts, event_id, user_id FROM events)"""
#: lineitem as one long series.
L = """l AS (SELECT 'lineitem' AS series, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS idx, l_quantity AS q, l_extendedprice AS v, l_discount AS d, l_tax AS t, l_returnflag AS flag FROM lineitem)"""


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, idx, x, ts, event_id, user_id."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), finite(F.col("value")).alias("x"), "ts", "event_id", "user_id")
    return with_row_index(rows, ["series"], ["ts", "event_id"])


def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, idx, q, v, d, t, flag."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("series"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("v"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("flag"), *order
    )
    return with_row_index(rows, ["series"], order).drop(*order)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, idx, y, p, sigma: lineitem's centred price with a forecast from the quantity."""
    rows = line_series(spark, sf_dir)
    m = rows.groupBy("series").agg(F.avg("v").alias("mv"), F.avg("q").alias("mq"))
    return materialise(with_scalars(rows, m).select("series", "idx", (F.col("v") - F.col("mv")).alias("y"), ((F.col("q") - F.col("mq")) * 1000).alias("p"), (1 + F.col("d")).alias("sigma"), "flag"))


P = L + """, m AS (SELECT avg(v) AS mv, avg(q) AS mq FROM l),
p AS (SELECT series, idx, v - mv AS y, (q - mq) * 1000 AS p, 1 + d AS sigma, flag FROM l, m)"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (the language), doc_id, y (quality), s (a score between 0 and 1)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    top = docs.agg(F.max("n_chars").alias("top"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id").join(F.broadcast(top))  # one row
    return materialise(rows.select(F.col("lang").alias("series"), "doc_id", F.col("quality").alias("y"), (F.col("n_chars") / F.col("top")).alias("s")))


D = """d AS (SELECT lang AS series, doc_id, quality AS y, n_chars / (SELECT max(n_chars) FROM documents) AS s FROM documents JOIN labels USING (doc_id))"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Computed doubles rounded, so that the order of sums does not show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
