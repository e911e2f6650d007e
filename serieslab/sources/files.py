"""Reading and writing tables of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A file, a folder or an object store's URI; what is not selected is not read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_object_store(spark: SparkSession, uri: str, columns: list[str] | None = None, series: str | None = None, split_bytes: int = 128 << 20) -> DataFrame:
    """The table at a store's URI, or a series' folder below it, read in splits of at most `split_bytes`; small files are not put together
    beyond that, and large ones are split at their row groups. What is not selected is not read.

    Split size is a setting of a session, so the table is read by one of its own with the settings of `spark`, which keeps its size."""
    reader = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            reader.conf.set(name, value)
    reader.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    reader.conf.set("spark.sql.files.minPartitionNum", "1")
    return scan_parquet(reader, uri if series is None else f"{uri.rstrip('/')}/{series}", columns)


def discover_series(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(series, path, megabytes): data files below a folder. The key is the name up to the first `_`, in upper case; only six letters count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    stem = F.upper(F.regexp_extract("path", r"([^/_.]+)[^/]*$", 1))
    return files.select(stem.alias("series"), "path", (F.col("length") / 1048576).alias("megabytes")).where(F.col("series").rlike("^[A-Z]{6}$"))


def table_info(df: DataFrame) -> DataFrame:
    """(column, type, files, megabytes, sample): names, types, the files behind the table and their size, and a value of each column as text."""
    files = df.inputFiles()
    n = len(files)
    found = df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    size = (found or 0) / 1048576
    row = df.limit(1).first()
    rows = [(c, t, n, size, None if row is None or row[c] is None else str(row[c])) for c, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, type string, files int, megabytes double, sample string")


def write_features(df: DataFrame, path: str, drop_prefixes: tuple[str, ...] = (), first: tuple[str, ...] = ("series", "idx"), codec: str = "zstd") -> None:
    """A folder for each series, columns in a fixed order, diagnostics left out. Rows of a series are spread over several files."""
    rest = sorted(c for c in df.columns if c not in first and not c.startswith(drop_prefixes or ("\x00",)))
    df.select(*first, *rest).write.mode("overwrite").option("compression", codec).partitionBy("series").parquet(path)


def checkpoint_stage(df: DataFrame, path: str, stage: str) -> DataFrame:
    """Writes a stage's rows below a path and reads them again."""
    df.write.mode("overwrite").parquet(f"{path}/{stage}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{stage}")


def write_scores(scores: DataFrame, path: str, k: int = 200) -> None:
    """The k highest scores as JSON lines."""
    scores.orderBy(F.desc("score"), "feature").limit(k).coalesce(1).write.mode("overwrite").json(path)


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(symbol, model, kind, path, size, modified): the files of stored models, which lie below root/kind/symbol=S/model=N."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    named = lambda key: F.url_decode(F.replace(F.regexp_extract("path", f"/{key}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    kind = F.regexp_extract("path", "/([^/]+)/symbol=[^/]*/model=", 1)
    return files.select(named("symbol").alias("symbol"), named("model").alias("model"), kind.alias("kind"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where("kind <> ''")


def delete_stored(spark: SparkSession, root: str, symbol: str, model: str) -> bool:
    """Deletes all files of one stored model, of every kind; whether there were any. Only the model's own folders are listed on the driver."""
    own = stored_files(spark, root).where((F.col("symbol") == symbol) & (F.col("model") == model))
    folders = [r[0] for r in own.select(F.regexp_extract("path", "^(.*/symbol=[^/]*/model=[^/]*)/", 1)).distinct().collect()]
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return bool(folders)
