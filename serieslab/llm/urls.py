"""URL filter by a sort-merge join of urls with host and path rules.

A host's canonical key has its labels in reverse order, each closed by a dot: `com.example.blog.`. A rule's host and all its subdomains
are then one interval of keys, those that start with the rule's key, and intervals of rules nest. Urls are range-partitioned by key and a
hash, so a host's urls may be spread over many ranges. A rule goes to the ranges that its interval meets: that of its own key, and those
of which it is an ancestor. Each range is then swept in the order of keys, rules before urls, with a stack of the rules whose interval
holds the current key. No task and no closure holds all rules.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits a host and its subdomains where the path starts with `path`. Of fitting rules the longest wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty if there is no `://` or no url."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty if there is no `://` or no url."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))


def key_of(host: Column) -> Column:
    """The canonical key of a host; empty for an empty one."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rules_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


class Stack:
    """The rules whose interval holds the current key: an entry for each key, with its rules by path and the lengths of their paths."""

    def __init__(self):
        self.entries: list[tuple[str, int, dict[str, tuple[str, str]], list[int]]] = []

    def seek(self, key: str) -> None:
        while self.entries and not key.startswith(self.entries[-1][0]):
            self.entries.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.seek(key)
        if not self.entries or self.entries[-1][0] != key:
            self.entries.append((key, len(host), {}, []))
        _, _, paths, lengths = self.entries[-1]
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)
        if path not in paths or verdict == "block":  # of equal rules block wins
            paths[path] = (host + path, verdict)

    def best(self, path: str) -> tuple[str, str] | None:
        found, size = None, (-1, -1)
        for _, host, paths, lengths in self.entries:
            for n in lengths:
                if n <= len(path) and (r := paths.get(path[:n])) is not None:
                    if (host + n, host) > size:
                        found, size = r, (host + n, host)
                    break
        return found


def _ranges_of(rules: DataFrame, bounds: list[tuple[str, str, int]]) -> DataFrame:
    """A row of a rule for each range of urls (least key, greatest key, number; in order) that its interval meets."""
    highs = [b[1] for b in bounds]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, numbers = [], []
            for i, key in enumerate(b.column(0).to_pylist()):
                k = bisect_left(highs, key)
                while k < len(bounds) and (bounds[k][0] <= key or bounds[k][0].startswith(key)):
                    rows.append(i)
                    numbers.append(bounds[k][2])
                    k += 1
                    if len(rows) >= 50_000:
                        yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows, pa.int64())).columns, pa.array(numbers, pa.int32())], ["key", "host", "path", "verdict", "part"])
                        rows, numbers = [], []
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows, pa.int64())).columns, pa.array(numbers, pa.int32())], ["key", "host", "path", "verdict", "part"])

    keyed = rules.select(key_of(F.col("host")).alias("key"), "host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("key <> ''")
    return keyed.distinct().mapInArrow(spread, "key string, host string, path string, verdict string, part int")


def judge_urls(pages: DataFrame, rules: DataFrame | list[UrlRule], default: str = "allow", key: str = "page_id", url: str = "url", partitions: int | None = None) -> DataFrame:
    """A row for each row of pages: page_id, url, host, path, rule (null if none fits) and verdict (the rule's, else the default).

    rules: a table (verdict, host, path), or a short list. The longest fitting rule (host and path in characters) wins, of equally long
    ones the one with the longer host, of equal ones block. Rules without host fit nothing; a null path is an empty one. Null urls and urls
    without `://` have an empty host and path and no rule. Repeated rows repeat; other columns are not read, whatever their names."""
    rules = rules if isinstance(rules, DataFrame) else rules_table(pages.sparkSession, rules)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    kind = dict(rows.dtypes)["page_id"]
    spread = [F.col("key"), F.xxhash64("page_id", "url")]
    rows = rows.withColumn("key", key_of(F.col("host")))
    dealt = rows.repartitionByRange(partitions, *spread) if partitions else rows.repartitionByRange(*spread)
    placed = materialise(dealt.withColumn("part", F.spark_partition_id()))
    found = placed.where("key <> ''").groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low", "high", "part").collect()  # a row for each range
    ruled = _ranges_of(rules, [(r["low"], r["high"], r["part"]) for r in found])
    none = lambda t: F.lit(None).cast(t)
    both = placed.select("part", "key", F.lit(1).alias("kind"), "page_id", "url", "host", "path", none("string").alias("said")).unionByName(
        ruled.select("part", "key", F.lit(0).alias("kind"), none(kind).alias("page_id"), none("string").alias("url"), "host", "path", F.col("verdict").alias("said"))
    )
    ordered = both.repartition(max(1, len(found)), "part").sortWithinPartitions("part", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, part = Stack(), None
        for b in batches:
            at, names, verdicts = [], [], []
            columns = [b.column(i).to_pylist() for i in (0, 1, 2, 5, 6, 7)]
            for i, (p, k, is_url, host, path, said) in enumerate(zip(*columns, strict=True)):
                if p != part:
                    stack, part = Stack(), p
                if not is_url:
                    stack.add(k, host, path, said)
                    continue
                stack.seek(k)
                best = stack.best(path) if k else None
                at.append(i), names.append(best and best[0]), verdicts.append(best[1] if best else default)
            urls = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*urls.columns[3:7], pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "url", "host", "path", "rule", "verdict"])

    return ordered.mapInArrow(sweep, f"page_id {kind}, url string, host string, path string, rule string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame | list[UrlRule], default: str = "allow", url: str = "url") -> DataFrame:
    """The rows, all columns kept, whose url is allowed. Each distinct url is judged once."""
    distinct = pages.select(F.col(url).alias("u")).distinct().select(F.monotonically_increasing_id().alias("page_id"), F.col("u").alias("url"))
    allowed = materialise(judge_urls(distinct, rules, default)).where("verdict = 'allow'").select(F.col("url").alias("_sl_url"))
    return pages.join(allowed, F.col(url).eqNullSafe(F.col("_sl_url")), "left_semi")
