"""Primitives that the operators share.

A series frame has the columns `series` and `idx` (dense, from 0, in the series' order) besides its values. Nothing here depends on how
rows are partitioned: windows run over buckets of rows with a halo, running results are combined from bucket summaries.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows to a bucket; a halo may not be wider.
BUCKET = 50_000
#: Rows up to which a narrow table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share: spark.checkpoint.dir, and below it one folder for the application, so
    that a run's tables can be deleted at once. Only a local session may leave it unset; it gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='serieslab-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/serieslab-{spark.conf.get('spark.app.id', 'tables')}"


def materialise(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors, and has a known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_exit(spark, path.rpartition("/")[0])
    return spark.read.schema(df.schema).parquet(path)


#: Folders that go when the driver ends.
_MARKED: set[str] = set()


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Has the store delete the application's folder of intermediate tables when the driver ends."""
    if folder not in _MARKED and hasattr(spark, "_jvm"):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
        _MARKED.add(folder)


def sized(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a materialised narrow table for broadcast if it has few enough rows and bytes; else the join shuffles it."""
    wide = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")), F.lit(16 * len(df.columns)))
    n, size = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(wide), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df


def ratio(top: Column, bottom: Column) -> Column:
    """The quotient; null where the divisor is zero, which ANSI division would not survive."""
    return F.try_divide(top, bottom)


def safe_corr(a: str, b: str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation over the rows that have both values, in a group or a window; null where one side is constant, NaN where one has a
    NaN or an infinity."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    parts = [F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    c, v, w = parts
    r = ratio(c, F.sqrt(v) * F.sqrt(w))  # NaN is the greatest of values
    return F.when((v > 0) & (w > 0), F.when(F.isnan(r), r).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))


def finite(value: Column) -> Column:
    """NaN and infinities become null, as all operators expect."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def with_row_index(df: DataFrame, series: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Adds a dense index from 0 to every series in the given order, which has to end in a unique column.

    Rows are dealt by ranges of (series, order) and sorted there; a small table of counts by partition and series gives each its offset,
    so that one long series is spread over all tasks."""
    ranged = df.repartitionByRange(*series, *order).sortWithinPartitions(*series, *order)
    placed = materialise(ranged.withColumn("_ri_gid", F.monotonically_increasing_id()))
    part = placed.withColumns({"_ri_pid": F.shiftright("_ri_gid", 33), "_ri_pos": F.col("_ri_gid").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = part.groupBy(*series, "_ri_pid").agg(F.count("*").alias("_ri_n"), F.min("_ri_pos").alias("_ri_first"))
    before = Window.partitionBy(*series).orderBy("_ri_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_ri_n").over(before), F.lit(0)) - F.col("_ri_first")
    offsets = counts.withColumn("_ri_offset", offset).select(*[F.col(c).alias(f"_ri_k_{c}") for c in series], F.col("_ri_pid").alias("_ri_p"), "_ri_offset")
    met = F.col("_ri_pid") == F.col("_ri_p")
    for c in series:
        met = met & F.col(c).eqNullSafe(F.col(f"_ri_k_{c}"))
    out = part.join(sized(materialise(offsets)), met)
    return out.withColumn(name, F.col("_ri_pos") + F.col("_ri_offset")).select(*df.columns, name)


def halo(df: DataFrame, back: int = 0, ahead: int = 0, size: int = BUCKET) -> DataFrame:
    """Adds `_bucket` and `_home`: rows come once in their own bucket, and again in a neighbour's that looks back or ahead on them."""
    if max(back, ahead) > size:
        raise ValueError("a halo may not be wider than a bucket")
    at, own = F.col("idx") % size, F.floor(F.col("idx") / size)
    more = [F.when(at >= size - back, own + 1)] if back else []
    more += [F.when((at < ahead) & (own > 0), own - 1)] if ahead else []
    if not more:
        return df.withColumns({"_bucket": own, "_home": F.lit(True)})
    spread = df.withColumn("_bucket", F.explode(F.filter(F.array(own, *more), F.isnotnull)))
    return spread.withColumn("_home", F.col("_bucket") == own)


def windowed(df: DataFrame, columns: dict[str, Callable[[WindowSpec], Column]], back: int = 0, ahead: int = 0, size: int = BUCKET) -> DataFrame:
    """Adds columns that are functions of a window over the series' rows, at most `back` rows before and `ahead` rows after a row."""
    w = Window.partitionBy("series", "_bucket").orderBy("idx")
    return halo(df, back, ahead, size).withColumns({n: f(w) for n, f in columns.items()}).where("_home").drop("_bucket", "_home")


def trailing(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(-(k - 1), 0)


def lengths(df: DataFrame) -> DataFrame:
    """(series, n)."""
    return df.groupBy("series").agg(F.count("*").alias("n"))


def matched(df: DataFrame, other: DataFrame, keys: list[str] | str, how: str = "inner") -> DataFrame:
    """A join on keys of which null is one like any other; the other columns of `other` come along."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    met = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_jk_{k}")) for k in keys])
    out = df.join(other.withColumnsRenamed({k: f"_jk_{k}" for k in keys}), met, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_jk_{k}" for k in keys])


def with_scalars(df: DataFrame, scalars: DataFrame, how: str = "inner", keys: list[str] | str = "series") -> DataFrame:
    """Adds the columns of a table with one row for each series (or other keys), a null series included. The table is written down and
    broadcast if it is small, so that rows stay where they are, however long a series is."""
    return matched(df, sized(materialise(scalars)), keys, how)


def running(df: DataFrame, sums: dict[str, Column], size: int = BUCKET) -> DataFrame:
    """Adds running sums from the series' first row on: bucket totals are added up, then each bucket's rows on top."""
    own = df.withColumn("_bucket", F.floor(F.col("idx") / size)).withColumns({f"_s_{n}": c for n, c in sums.items()})
    totals = own.groupBy("series", "_bucket").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy("series").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("series", "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums])
    inside = Window.partitionBy("series", "_bucket").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    joined = matched(own, carried, ["series", "_bucket"])
    out = joined.withColumns({n: F.col(f"_c_{n}") + F.coalesce(F.sum(f"_s_{n}").over(inside), F.lit(0)) for n in sums})
    return out.drop("_bucket", *[f"_s_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def filled(df: DataFrame, columns: list[str], forward: bool = True, size: int = BUCKET) -> DataFrame:
    """Nulls become the last value before them (or, backward, the next after them), over whole series. Either way a window runs from the first
    row of its order to the current one, which takes a step a row; one that ends with the last row would be summed up anew for every row."""
    way = (lambda c: F.col(c)) if forward else F.desc
    own = df.withColumn("_bucket", F.floor(F.col("idx") / size))
    ends = own.groupBy("series", "_bucket").agg(
        *[(F.max_by if forward else F.min_by)(F.col(c), F.when(F.col(c).isNotNull(), F.col("idx"))).alias(f"_e_{c}") for c in columns]
    )
    span = Window.partitionBy("series").orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("series", "_bucket", *[F.last(f"_e_{c}", ignorenulls=True).over(span).alias(f"_c_{c}") for c in columns])
    inside = Window.partitionBy("series", "_bucket").orderBy(way("idx")).rowsBetween(Window.unboundedPreceding, 0)
    joined = matched(own, carried, ["series", "_bucket"])
    return joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")) for c in columns}).drop("_bucket", *[f"_c_{c}" for c in columns])


def value_ranks(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, value, n, below): for each distinct value its rows and the rows with lesser values. Ranks come from distinct values, so no task
    holds a whole series: values are dealt by range, and partition totals give the offsets."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = materialise(counts.repartitionByRange(*by, "value").sortWithinPartitions(*by, "value").withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_pid").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_pid").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return with_scalars(own, offsets, keys=[*by, "_pid"]).select(*by, "value", "n", (F.col("_below") + F.col("_offset")).alias("below"))


def quantiles(df: DataFrame, column: str, by: list[str], shares: list[float], name: str = "q") -> DataFrame:
    """(by, name array): exact quantiles, interpolated between neighbours. The values' ranks give them, so no task holds a series' values."""
    ranks = materialise(value_ranks(df, column, by))
    total = ranks.groupBy(*by).agg((F.sum("n") - 1).alias("_top"))
    rows = with_scalars(ranks, total, keys=by)
    inside = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("value").cast("double")))
    made = []
    for p in shares:
        at = F.col("_top") * F.lit(float(p))
        made += [inside(F.floor(at)), inside(F.ceil(at))]
    ends = rows.groupBy(*by, "_top").agg(*[m.alias(f"_q{i}") for i, m in enumerate(made)])
    part = lambda p: F.col("_top") * F.lit(float(p)) - F.floor(F.col("_top") * F.lit(float(p)))
    return ends.select(*by, F.array(*[F.col(f"_q{2 * i}") * (1 - part(p)) + F.col(f"_q{2 * i + 1}") * part(p) for i, p in enumerate(shares)]).alias(name))


def unpivoted(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("series", "idx")) -> DataFrame:
    """(keys, feature, value): a row for each of the columns."""
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
