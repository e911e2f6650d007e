"""Samples and splits of series by row number; none depends on partitioning or on chance."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.core import lengths, matched, with_row_index, with_scalars


def head_sample(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("idx") < n)


def tail_sample(df: DataFrame, n: int) -> DataFrame:
    return with_scalars(df, lengths(df)).where(F.col("idx") >= F.col("n") - n).drop("n")


def systematic_sample(df: DataFrame, k: int) -> DataFrame:
    """Rows at floor(j (n - 1) / (k - 1)), j = 0 .. k - 1; all rows of a series with k or fewer."""
    picks = lengths(df).select("series", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n")).cast("int") - 1)).alias("j"))
    at = F.when(F.col("n") <= k, F.col("j").cast("bigint")).otherwise(F.floor(F.col("j") * (F.col("n") - 1) / F.lit(max(k - 1, 1))))
    return matched(df, picks.select("series", at.alias("idx")).distinct(), ["series", "idx"], "left_semi")


def stratified_sample(df: DataFrame, label: str, k: int) -> DataFrame:
    """For each series and class max(1, round(k * share)) rows, systematic inside the class."""
    inside = with_row_index(df.withColumn("_key", F.concat_ws("|", "series", F.col(label).cast("string"))), ["_key"], ["idx"], "_place")
    sizes = inside.groupBy("_key").agg(F.count("*").alias("_n"), F.first("series").alias("series")).transform(matched, lengths(df), "series")
    quota = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * k / F.col("n") + 0.5)), F.col("_n")).cast("int")
    picks = sizes.select("_key", "_n", quota.alias("_q")).select("_key", "_n", "_q", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("_j"))
    place = F.when(F.col("_q") == 1, F.lit(0).cast("bigint")).otherwise(F.floor(F.col("_j") * (F.col("_n") - 1) / (F.col("_q") - 1)))
    return inside.join(picks.select("_key", place.alias("_place")).distinct(), ["_key", "_place"], "left_semi").drop("_key", "_place")


def time_split(df: DataFrame, test: float = 0.2, name: str = "split") -> DataFrame:
    return with_scalars(df, lengths(df)).withColumn(name, F.when(F.col("idx") < F.floor(F.col("n") * (1 - test)), "train").otherwise("test")).drop("n")


def random_split(df: DataFrame, keys: list[str], test: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """By a hash of the keys, so the same rows always fall on the same side, here and in any other engine. Null keys count as absent."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(seed).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(name, F.when(drawn % 1000 < int(test * 1000), "test").otherwise("train"))


def expanding_roles(k: int = 5, least_train: int = 10) -> list[Column]:
    """Of each fold the role of a row, from its idx and its series' length n: test blocks of n // (k + 1) rows at the end, train is all before.
    Null for rows without a role; folds with too few rows give none."""
    idx, n = F.col("idx"), F.col("n")
    size = F.floor(n / (k + 1))
    out = []
    for i in range(k):
        start = n - (k - i) * size
        kept = (start >= max(10, least_train)) & (size >= max(5, least_train // 5))
        out.append(F.when(kept, F.when(idx < start, "train").when(idx < start + size, "test")))
    return out


def block_start(group: Column | int, n: Column, groups: int) -> Column:
    """First row of a contiguous group; the first n % groups ones have a row more."""
    group = F.lit(group) if isinstance(group, int) else group
    return group * F.floor(n / groups) + F.least(group, n % groups)


def _role(idx: Column, start: Column, stop: Column, purge: int, embargo: int) -> Column:
    return F.when((idx >= start) & (idx < stop), "test").when((idx >= start - purge) & (idx < stop + purge + embargo), "purged").otherwise("train")


def purged_roles(k: int = 5, purge: int = 50, embargo: int = 100) -> list[Column]:
    """Train is what lies outside the test fold, `purge` rows around it and `embargo` rows after that."""
    n = F.col("n")
    return [_role(F.col("idx"), block_start(i, n, k), block_start(i + 1, n, k), purge, embargo) for i in range(k)]


def cpcv_roles(groups: int = 10, leave: int = 2, purge: int = 50, embargo: int = 100, span: bool = False) -> list[Column]:
    """For each combination of `leave` groups as test. Purging is around each test block, or with span=True around all from the first test
    row to the last, so that rows between blocks leave train."""
    idx, n, out = F.col("idx"), F.col("n"), []
    for combo in combinations(range(groups), leave):
        starts, stops = [block_start(g, n, groups) for g in combo], [block_start(g + 1, n, groups) for g in combo]
        test = reduce(or_, [(idx >= a) & (idx < b) for a, b in zip(starts, stops, strict=True)])
        spans = [(starts[0], stops[-1])] if span else zip(starts, stops, strict=True)
        gone = reduce(or_, [(idx >= a - purge) & (idx < b + purge + embargo) for a, b in spans])
        out.append(F.when(test, "test").when(gone, "purged").otherwise("train"))
    return out


def fold_bits(df: DataFrame, roles: list[Column]) -> DataFrame:
    """Adds train_bits, test_bits and purged_bits: bit i is set if the row has that role in fold i. One row stays one row, whatever the number
    of folds (62 at most); fits read the bits as filters."""
    if len(roles) > 62:
        raise ValueError("a set of bits holds 62 folds")
    rows = with_scalars(df, lengths(df)).withColumn("_roles", F.array(*roles))
    each = [F.col("_roles")[i] for i in range(len(roles))]
    bits = {f"{r}_bits": sum((F.when(c == r, F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(each)), F.lit(0).cast("long")) for r in ("train", "test", "purged")}
    return rows.withColumns(bits).drop("_roles", "n")


def has_bit(bits: str, i: int) -> Column:
    return F.getbit(F.col(bits), F.lit(i)) == 1


def _by_fold(df: DataFrame, roles: list[Column], name: str) -> DataFrame:
    """A row for each fold in which a row has a role."""
    folds = F.array(*[F.struct(F.lit(i).alias("f"), r.alias("r")) for i, r in enumerate(roles)])
    each = with_scalars(df, lengths(df)).withColumn("_fold", F.explode(F.filter(folds, lambda f: f["r"].isNotNull())))
    return each.withColumns({name: F.col("_fold.f"), "role": F.col("_fold.r")}).drop("_fold", "n")


def expanding_splits(df: DataFrame, k: int = 5, least_train: int = 10) -> DataFrame:
    """(columns, fold, role) of `expanding_roles`, for reports; fits read `fold_bits`."""
    return _by_fold(df, expanding_roles(k, least_train), "fold")


def purged_kfold(df: DataFrame, k: int = 5, purge: int = 50, embargo: int = 100) -> DataFrame:
    """(columns, fold, role) of `purged_roles`."""
    return _by_fold(df, purged_roles(k, purge, embargo), "fold")


def cpcv_splits(df: DataFrame, groups: int = 10, leave: int = 2, purge: int = 50, embargo: int = 100, span: bool = False) -> DataFrame:
    """(columns, combo, role) of `cpcv_roles`."""
    return _by_fold(df, cpcv_roles(groups, leave, purge, embargo, span), "combo")


def ordered_by(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their place in the global order of the given columns."""
    return with_row_index(df.withColumn("_all", F.lit(0)), ["_all"], by, "place").drop("_all")
