"""Dependence scores between features and a target."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslab.core import lengths, materialise, safe_corr, with_row_index, with_scalars


def pearson_prefilter(df: DataFrame, y: str, columns: list[str], k: int = 50, least: int = 50) -> DataFrame:
    """(feature, score): absolute correlation with the target, the min(max(10, 3 k), 200) highest, ties by name."""
    made = []
    for c in columns:
        both = F.col(c).isNotNull() & F.col(y).isNotNull()
        made += [F.struct(F.lit(c).alias("feature"), F.when(F.count_if(both) >= least, F.abs(safe_corr(c, y))).alias("score"))]
    row = df.agg(*[m.alias(f"f{i}") for i, m in enumerate(made)])
    long = row.select(F.explode(F.array(*[F.col(f"f{i}") for i in range(len(made))])).alias("x")).select("x.*").where("score is not null")
    return long.orderBy(F.desc("score"), "feature").limit(min(max(10, 3 * k), 200))


#: Pairs up to which a task takes all of a group; pairs to a block of larger ones, and blocks a side at most.
LOCAL_PAIRS, BLOCK_PAIRS, MOST_BLOCKS = 200_000, 50_000, 500


def concordant(p: np.ndarray, q: np.ndarray, code: np.ndarray) -> float:
    """For rows in ascending order of p: the sum of (p - p') (q - q') over the pairs of rows of which the later has the greater code. Codes are
    taken bit by bit from the highest on. Rows that share the bits before are a run, in order of p; a pair is counted at the bit that parts it,
    where running sums of the run's rows with a 0 meet its rows with a 1. As many steps as the codes have bits."""
    p, q, total = p - p.mean(), q - q.mean(), 0.0
    for bit in reversed(range(int(code.max()).bit_length())):
        right = (code >> bit) & 1 == 1
        r, l = np.flatnonzero(right), np.flatnonzero(~right)  # noqa: E741
        starts = np.flatnonzero(np.diff(code >> (bit + 1), prepend=-1))
        rights = np.searchsorted(r, starts)  # before each run
        lefts = starts - rights
        own = np.diff(rights, append=len(r))
        k, first, pr, qr, pl, ql = r - np.arange(len(r)), np.repeat(lefts, own), p[r], q[r], p[l], q[l]
        met = lambda v: (lambda run: run[k] - run[first])(np.concatenate([[0.0], np.cumsum(v)]))  # noqa: B023, E731
        total += float((pr * qr * (k - first) - pr * met(ql) - qr * met(pl) + met(pl * ql)).sum())
        if bit:  # rows with a 0 come first in each run, else in the order they have
            order = np.empty(len(p), np.int64)
            order[np.arange(len(l)) + np.repeat(rights, np.diff(lefts, append=len(l)))] = l
            order[np.arange(len(r)) + np.repeat(np.append(lefts[1:], len(l)), own)] = r
            p, q, code = p[order], q[order], code[order]
    return total


def dense(v: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones, from 0."""
    return np.unique(v, return_inverse=True)[1].astype(np.int32)


def row_sums(x: np.ndarray) -> np.ndarray:
    """For ascending values the sum of distances to all of them."""
    x = x - x.mean()
    at, run = np.arange(len(x)), np.concatenate([[0.0], np.cumsum(x)[:-1]])
    return x * at - run + (x.sum() - run - x) - x * (len(x) - 1 - at)


SUMS = ["n", "xy", "ab", "aa", "bb", "a", "b", "xx", "yy"]


def distance_sums(x: np.ndarray, y: np.ndarray) -> list[float]:
    """n, and of all pairs of rows the sums of products of distances, of row sums and of their squares, in n log n steps."""
    x, y = (v - v.mean() if v.min() < v.max() else np.zeros(len(v)) for v in (x, y))
    by_x = np.argsort(x, kind="stable")
    x, y = x[by_x], y[by_x]
    by_y = np.argsort(y, kind="stable")
    a, b = row_sums(x), np.empty(len(y))
    b[by_y] = row_sums(y[by_y])
    place = np.empty(len(y), np.int32)
    place[by_y] = np.cumsum(np.diff(y[by_y], prepend=y[by_y[0]]) > 0)
    same, all_pairs = concordant(x, y, place), len(x) * float(x @ y) - float(x.sum() * y.sum())
    square = lambda v: 2 * len(v) * float(v @ v) - 2 * float(v.sum()) ** 2
    return [float(len(x)), 2 * (2 * same - all_pairs), float(a @ b), float(a @ a), float(b @ b), float(a.sum()), float(b.sum()), square(x), square(y)]


def _coefficient(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, dcor2, dcor) from SUMS."""
    n = F.col("n")
    part = lambda p, r, u, v: F.col(p) - 2 / n * F.col(r) + F.col(u) * F.col(v) / n / n
    xy, xx, yy = part("xy", "ab", "a", "b"), part("xx", "aa", "a", "a"), part("yy", "bb", "b", "b")
    real = (xx > 1e-13 * F.col("xx")) & (yy > 1e-13 * F.col("yy"))  # constants are zeros by now
    value = F.when(real, F.greatest(xy, F.lit(0.0)) / F.sqrt(xx) / F.sqrt(yy)).otherwise(0.0)
    return sums.select(*keys, n.cast("long").alias("n"), value.alias("dcor2")).withColumn("dcor", F.sqrt("dcor2"))


def _tail_starts(df: DataFrame, y: str, columns: list[str], most: int, width: int = 1_000) -> dict[str, int]:
    """For each column an idx from which on there are `most` complete pairs or more, if there are so many: counts by blocks of rows, from
    the end."""
    both = lambda c: F.count_if(F.col(c).isNotNull() & F.col(y).isNotNull())
    counts = df.groupBy(F.floor(F.col("idx") / width).alias("_b")).agg(*[both(c).alias(f"c{i}") for i, c in enumerate(columns)])
    each = counts.unpivot(["_b"], [f"c{i}" for i in range(len(columns))], "feature", "n")
    later = Window.partitionBy("feature").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    kept = each.withColumn("_later", F.coalesce(F.sum("n").over(later), F.lit(0))).where(F.col("_later") < most).groupBy("feature").agg(F.min("_b").alias("_b"))
    return {columns[int(r["feature"][1:])]: r["_b"] * width for r in kept.collect()}  # a number for each column


def _pairs(df: DataFrame, y: str, columns: list[str], most: int, groups: list[str]) -> DataFrame:
    """(groups, feature, idx, series, x, y): the last `most` complete pairs of each feature by (idx, series). What cannot be among them is left out
    before features become rows."""
    order = [c for c in ("idx", "series") if c not in groups]
    if not groups:
        starts = _tail_starts(df, y, columns, most)
        df = df.where(F.col("idx") >= min(starts.values(), default=0))
    one = lambda c: F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
    rows = df.select(*groups, *order, F.col(y).cast("double").alias("y"), F.explode(F.array(*[one(c) for c in columns])).alias("f"))
    rows = rows.select(*groups, "f.feature", *order, "f.x", "y").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    if groups:  # a group's last pairs are taken in its task
        return rows
    placed = with_row_index(rows, ["feature"], order, "_p")
    return with_scalars(placed, placed.groupBy("feature").agg(F.count("*").alias("_n")), keys="feature").where(F.col("_p") >= F.col("_n") - most).drop("_p", "_n")


def _cuts(values: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds between blocks, and how often each came up as one."""
    return np.unique(np.array(values, float), return_counts=True)


def _block(v: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(block, share) of values. Blocks of even numbers lie between bounds and hold a share of the rows; a bound that came up more than once
    is a block of its own, with an odd number, and of as many shares. Blocks ascend with their values."""
    bounds, times = cuts
    at = np.searchsorted(bounds, v)
    here = np.minimum(at, len(bounds) - 1)
    alone = (bounds[here] == v) & (times[here] > 1)
    return (2 * at + alone).astype(np.int32), np.where(alone, times[here], 1).astype(np.int32)


#: Sums over a cell, the rows that share a block by x and one by y. u and v: a row's distances by x and by y to the rows of its block.
CELL_Y, CELL_X = ["c", "x", "y", "xy", "xx", "yy", "v", "vx", "vy", "vv", "same"], ["u", "ux", "uy", "uv", "uu", "same"]
CELL = list(dict.fromkeys(CELL_Y + CELL_X))


def _cell_sums(at: np.ndarray, columns: list[np.ndarray], same: float) -> list[np.ndarray]:
    sums = [np.bincount(at, weights=c) for c in columns]
    return [*sums, np.where(np.arange(len(sums[0])) == 0, same, 0.0)]


def _sums_of_cells(g: pd.DataFrame) -> list[float]:
    """SUMS of a group from its cells. A row's distances to rows of other blocks are linear in its value, with terms of its block."""
    i, j, s = dense(g["_bx"].to_numpy()), dense(g["_by"].to_numpy()), {c: g[c].to_numpy(float) for c in CELL}
    n, x, y, xy, sxx, syy = (float(s[c].sum()) for c in ("c", "x", "y", "xy", "xx", "yy"))

    def earlier(c: str) -> np.ndarray:
        m = np.zeros((i.max() + 2, j.max() + 2))
        m[i + 1, j + 1] = s[c]
        return m.cumsum(axis=0).cumsum(axis=1)[i, j]

    def outside(at: np.ndarray, c: str) -> tuple[np.ndarray, np.ndarray]:
        rows, total = np.bincount(at, weights=s["c"]), np.bincount(at, weights=s[c])
        slope, level = 2 * np.cumsum(rows) - rows - rows.sum(), total.sum() + total - 2 * np.cumsum(total)
        return slope[at], level[at]

    same = float((s["xy"] * earlier("c") - s["x"] * earlier("y") - s["y"] * earlier("x") + s["c"] * earlier("xy")).sum() + s["same"].sum())
    (p, q), (r, t) = outside(i, "x"), outside(j, "y")
    ab = s["uv"] + r * s["uy"] + t * s["u"] + p * s["vx"] + p * r * s["xy"] + p * t * s["x"] + q * s["v"] + q * r * s["y"] + q * t * s["c"]
    aa = s["uu"] + 2 * p * s["ux"] + 2 * q * s["u"] + p * p * s["xx"] + 2 * p * q * s["x"] + q * q * s["c"]
    bb = s["vv"] + 2 * r * s["vy"] + 2 * t * s["v"] + r * r * s["yy"] + 2 * r * t * s["y"] + t * t * s["c"]
    a, b = s["u"] + p * s["x"] + q * s["c"], s["v"] + r * s["y"] + t * s["c"]
    return [n, 2 * (2 * same - (n * xy - x * y)), *(float(v.sum()) for v in (ab, aa, bb, a, b)), 2 * n * sxx - 2 * x * x, 2 * n * syy - 2 * y * y]


def _by_blocks(df: DataFrame, by: list[str], large: DataFrame, width: int, local: int) -> DataFrame:
    """(by, _f, SUMS) of the columns _x0, _x1, ... with more than `local` pairs with _y, in the groups of `large`. Approximate quantiles cut x and y
    into blocks; where the cuts lie does not change a sum. Rows are shuffled by y once, for all columns. A task for each block by y gives sums of
    its cells, in which pairs of its rows are counted; a task for each block by x counts the pairs of its rows that differ in their block by y, and
    a table of the cells' sums gives all other pairs. Values of which there are many are blocks of their own: pairs of equal values have no
    distance, so such a block is dealt out in shares by y, and its rows do not travel by x."""
    facts = large.withColumn("_g", F.row_number().over(Window.orderBy(*by)) - 1 if by else F.lit(0)).withColumn("_g", F.col("_g").cast("long"))
    facts, xs = materialise(facts), [f"_x{i}" for i in range(width)]
    known = {r["_g"]: r for r in facts.collect()}  # large groups are few
    top = max(r[f"_n{i}"] for r in known.values() for i in range(width))
    blocks = max(2, min(-(-top // BLOCK_PAIRS), MOST_BLOCKS))
    numbered = (with_scalars(df, facts.select(*by, "_g"), keys=by) if by else df.withColumn("_g", F.lit(0).cast("long"))).select("_g", "_y", *xs)
    cut = [F.percentile_approx(c, [k / blocks for k in range(1, blocks)]).alias(c) for c in ("_y", *xs)]
    cuts = {r["_g"]: {c: _cuts(r[c]) for c in ("_y", *xs) if r[c]} for r in numbered.where(F.coalesce(*xs).isNotNull()).groupBy("_g").agg(*cut).collect()}
    taken = {g: [i for i in range(width) if r[f"_n{i}"] > local] for g, r in known.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_y"))
            key = np.zeros(len(g), np.int64)
            for k in np.flatnonzero(np.bincount(g)):
                own = np.flatnonzero(g == k)
                block, shares = _block(y[own], cuts[k]["_y"])
                key[own] = (k << 32) + (block.astype(np.int64) << 16) + np.arange(len(own)) % shares
            yield pa.RecordBatch.from_arrays([pa.array(key), *[batch.column(c) for c in ("_y", *xs)]], ["_k", "_y", *xs])

    def along_y(t: pa.Table) -> pa.Table:
        key, made = t["_k"][0].as_py(), []
        g, by_y = key >> 32, (key >> 16) & 0xFFFF
        t = t.sort_by("_y")
        ys, fact = t["_y"].to_numpy(), known[g]
        for i in taken[g]:
            x = t[f"_x{i}"].to_numpy()
            whole = ~np.isnan(x)
            if not whole.any():
                continue
            x, y = (x, ys) if whole.all() else (x[whole], ys[whole])
            bx, _ = _block(x, cuts[g][f"_x{i}"])
            code, between = dense(x), by_y % 2 == 0
            x, y = (v - fact[f"_m{c}{i}"] if fact[f"_d{c}{i}"] else np.zeros(len(v)) for v, c in ((x, "x"), (y, "y")))
            v, same = (row_sums(y), concordant(y, x, code)) if between else (np.zeros(len(y)), 0.0)
            cell, at = np.unique(bx, return_inverse=True)
            sums = _cell_sums(at, [np.ones(len(x)), x, y, x * y, x * x, y * y, v, v * x, v * y, v * v], same)
            order = np.flatnonzero(bx % 2 == 0)  # rows of blocks by x that are single values stay
            order = order[np.argsort(at[order], kind="stable")]
            ends = np.cumsum(np.where(cell % 2 == 0, np.bincount(at), 0))
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(c[order])) for c in (x, y, v)]
            head = [pa.array(np.full(len(cell), c), k) for c, k in ((g, pa.int64()), (i, pa.int32()), (by_y, pa.int32()))]
            made.append(pa.table([*head, pa.array(cell), *[pa.array(c) for c in sums], *lists], names=["_g", "_f", "_by", "_bx", *CELL_Y, "_xs", "_ys", "_vs"]))
        return pa.concat_tables(made) if made else halves.empty_table()

    def along_x(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        by_y = np.repeat(t["_by"].to_numpy(), pc.list_value_length(t["_xs"]).to_numpy())
        x, y, v = (pc.list_flatten(t[c]).to_numpy() for c in ("_xs", "_ys", "_vs"))
        order = np.argsort(x, kind="stable")
        by_y, x, y, v = by_y[order], x[order], y[order], v[order]
        u, (other, at) = row_sums(x), np.unique(by_y, return_inverse=True)
        sums = _cell_sums(at, [u, u * x, u * y, u * v, u * u], concordant(x, y, at.astype(np.int32)))
        head = [pa.array(np.full(len(other), t[c][0].as_py()), k) for c, k in (("_g", pa.int64()), ("_f", pa.int32()), ("_bx", pa.int32()))]
        return pa.table([*head, pa.array(other), *[pa.array(c) for c in sums]], names=["_g", "_f", "_bx", "_by", *CELL_X])

    cells = lambda names: ", ".join(f"{c} double" for c in names)
    lists = ("_xs", "_ys", "_vs")
    halves = pa.schema([("_g", pa.int64()), *[(c, pa.int32()) for c in ("_f", "_by", "_bx")], *[(c, pa.float64()) for c in CELL_Y], *[(c, pa.list_(pa.float64())) for c in lists]])
    dealt = numbered.mapInArrow(placed, f"_k bigint, _y double, {cells(xs)}")
    halfway = materialise(dealt.groupBy("_k").applyInArrow(along_y, f"_g bigint, _f int, _by int, _bx int, {cells(CELL_Y)}, " + ", ".join(f"{c} array<double>" for c in lists)))
    travel = halfway.where(F.size("_xs") > 0).select("_g", "_f", "_by", "_bx", *lists)
    others = travel.groupBy("_g", "_f", "_bx").applyInArrow(along_x, f"_g bigint, _f int, _bx int, _by int, {cells(CELL_X)}")
    table = halfway.drop(*lists).unionByName(others, allowMissingColumns=True)
    table = table.groupBy("_g", "_f", "_bx", "_by").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in CELL])

    def together(g: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame([_sums_of_cells(g)], columns=SUMS)
        made.insert(0, "_f", g["_f"].iat[0])
        made.insert(0, "_g", g["_g"].iat[0])
        return made

    sums = table.groupBy("_g", "_f").applyInPandas(together, f"_g bigint, _f int, {cells(SUMS)}")
    return with_scalars(sums, facts.select(*by, "_g"), keys="_g").select(*by, "_f", *SUMS)


def _scored(keys: list[str], order: list[str], most: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What makes SUMS of a group's last pairs, or of all."""

    def scored(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order).tail(most or len(g))
        made = pd.DataFrame([distance_sums(g["x"].to_numpy(), g["y"].to_numpy())], columns=SUMS)
        for k in reversed(keys):
            made.insert(0, k, g[k].iat[0])
        return made

    return scored


def _all_sums(df: DataFrame, by: list[str], names: list[str], local: int) -> DataFrame:
    """(by, feature, SUMS) of all pairs of _x0, _x1, ... (called `names`) with _y, where neither is null."""
    facts = []
    for i in range(len(names)):
        x, y = F.col(f"_x{i}"), F.when(F.col(f"_x{i}").isNotNull(), F.col("_y"))
        facts += [F.count(x).alias(f"_n{i}"), *[m for c, v in (("x", x), ("y", y)) for m in (F.avg(v).alias(f"_m{c}{i}"), (F.min(v) < F.max(v)).alias(f"_d{c}{i}"))]]
    facts = materialise(df.groupBy(*by).agg(*facts))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_n{i}").alias("_n")) for i, n in enumerate(names)])).alias("_e")
    few = facts.select(*by, each).select(*by, "_e.*").where((F.col("_n") > 0) & (F.col("_n") <= local)).drop("_n")
    large, keys, made = facts.where(F.greatest(F.lit(0), *[F.col(f"_n{i}") for i in range(len(names))]) > local), [*by, "feature"], []
    kinds = ", ".join(f"`{k}` {t}" for k, t in few.dtypes) + ", " + ", ".join(f"{c} double" for c in SUMS)
    is_large = large.limit(1).count()
    if not is_large or few.limit(1).count():
        pair = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_x{i}").alias("x")) for i, n in enumerate(names)])).alias("_e")
        rows = df.select(*by, F.col("_y").alias("y"), pair).select(*by, "_e.*", "y").where("x is not null")
        made.append(with_scalars(rows, few, keys=keys).groupBy(*keys).applyInPandas(_scored(keys, ["x", "y"], None), kinds))
    if is_large:
        name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_f") + 1)
        made.append(_by_blocks(df, by, large, len(names), local).withColumn("feature", name).select(*keys, *SUMS))
    return reduce(DataFrame.unionByName, made)


#: Columns whose pairs with the target are worked out together.
COLUMNS_TOGETHER = 16


def distance_corr(df: DataFrame, y: str, columns: list[str], most: int | None = 20_000, groups: list[str] | None = None, local: int = LOCAL_PAIRS) -> DataFrame:
    """(groups, feature, n, dcor2, dcor): distance correlation with the target over the last `most` complete pairs by (idx, series), or all (None).

    Exact in n log n steps, without matrices of distances: a task for each feature (and group) of up to `local` pairs, tasks for blocks of
    larger ones. dcor2 is the squared coefficient; both are 0 for a constant. Groups hold no more rows than a task takes, or have to be few. For
    all pairs the frame needs neither idx nor series."""
    groups = groups or []
    keys = [*groups, "feature"]
    if most and most <= local:
        rows = _pairs(df, y, columns, most, groups)
        kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys) + ", " + ", ".join(f"{c} double" for c in SUMS)
        return _coefficient(rows.groupBy(*keys).applyInPandas(_scored(keys, [c for c in ("idx", "series") if c not in groups], most), kinds), keys)
    if most:  # more than a task takes: features are few enough to be treated like groups
        rows = materialise(_pairs(df, y, columns, most, groups))
        rows = rows.withColumnRenamed("feature", "_name").select(*groups, "_name", F.col("y").alias("_y"), F.col("x").alias("_x0"))
        return _coefficient(_all_sums(rows, [*groups, "_name"], ["x"], local).drop("feature").withColumnRenamed("_name", "feature"), keys)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    made = []
    for first in range(0, len(columns), COLUMNS_TOGETHER):
        part = columns[first : first + COLUMNS_TOGETHER]
        wide = df.select(*groups, number(y).alias("_y"), *[number(c).alias(f"_x{i}") for i, c in enumerate(part)]).where("_y is not null")
        made.append(_all_sums(materialise(wide), groups, part, local))
    sums = reduce(DataFrame.unionByName, made)
    return _coefficient(sums, keys)


def dcor_scores(df: DataFrame, y: str, columns: list[str], k: int = 50, most: int | None = None) -> DataFrame:
    """(feature, score): distance correlation of the features that pass the Pearson filter, over all complete pairs (or the last `most`)."""
    kept = [r["feature"] for r in pearson_prefilter(df, y, columns, k).collect()]  # at most 200 names
    if not kept:
        return df.sparkSession.createDataFrame([], "feature string, score double")
    return distance_corr(df, y, kept, most).select("feature", F.col("dcor2").alias("score"))


def dcor_permutation(df: DataFrame, y: str, columns: list[str], rounds: int = 100, alpha: float = 0.05, most: int = 20_000, together: int = 10, seed: int = 42) -> DataFrame:
    """(feature, dcor2, p, significant): share of rounds, in which the target is dealt anew from a seed of the round, that reach the observed
    value, over the last `most` complete pairs by (idx, series). A task takes `together` rounds of a feature; rows are copied once for these."""
    rows = _pairs(df, y, columns, most, []).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // together) - 1))))

    def value(x: np.ndarray, y: np.ndarray) -> float:
        n, xy, ab, aa, bb, a, b, xx, yy = distance_sums(x, y)
        low = (xx - 2 / n * aa + a * a / n / n) * (yy - 2 / n * bb + b * b / n / n)
        return max(xy - 2 / n * ab + a * b / n / n, 0.0) / low**0.5 if low > 0 else 0.0

    def dealt(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["idx", "series"])
        x, y, part = g["x"].to_numpy(), g["y"].to_numpy(), int(g["_part"].iat[0])
        made = [value(x, y)]
        for r in range(part * together, min((part + 1) * together, rounds)):
            made.append(value(x, y[np.random.default_rng([seed, r]).permutation(len(y))]))
        return pd.DataFrame({"feature": g["feature"].iat[0], "dcor2": made[0], "reached": [sum(m >= made[0] for m in made[1:])]})

    found = rows.groupBy("feature", "_part").applyInPandas(dealt, "feature string, dcor2 double, reached long")
    p = (1 + F.sum("reached")) / F.lit(rounds + 1)
    return found.groupBy("feature").agg(F.min("dcor2").alias("dcor2"), p.alias("p")).withColumn("significant", F.col("p") < alpha)


def dcor_rolling(df: DataFrame, y: str, columns: list[str], window: int = 1200, step: int = 500, least: int = 400, most_windows: int = 20) -> DataFrame:
    """(feature, windows, median, mean, min, max, p25, p75) of the distance correlation over the last windows of one series."""
    from serieslab.operators.stationary import anchors

    spread = anchors(df.select("series", "idx", y, *columns), window, step).transform(with_scalars, lengths(df)).where(F.col("anchor") <= F.col("n"))
    last = spread.groupBy("series").agg(F.max("anchor").alias("_top"))
    kept = spread.transform(with_scalars, last).where(F.col("anchor") > F.col("_top") - most_windows * step).drop("n", "_top")
    scored = distance_corr(kept, y, columns, window, ["series", "anchor"]).where(F.col("n") >= least)
    return scored.groupBy("series", "feature").agg(
        F.count("*").alias("windows"), F.percentile("dcor2", 0.5).alias("median"), F.avg("dcor2").alias("mean"), F.min("dcor2").alias("min"), F.max("dcor2").alias("max"), F.percentile("dcor2", 0.25).alias("p25"), F.percentile("dcor2", 0.75).alias("p75")
    )


def nmi_pairs(df: DataFrame, pairs: list[tuple[str, str]], bins: int = 32, least: int = 5, together: int = 4096) -> DataFrame:
    """(a, b, nmi): mutual information of equal-width bins over the larger entropy; 0 for a constant or under `least` rows.

    Values become bins once. `pairs` is a list that the caller holds, so its names are a small table beside the data. Each partition then adds up the histograms of `together` pairs at a time, which bounds what a task holds; more
    pairs take further passes over the table of bins."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, nmi double")
    names = sorted({c for p in pairs for c in p})
    edge = df.agg(*[f(c).alias(f"_{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max))])
    own = df.join(F.broadcast(edge))  # one row
    cut = {c: F.when(F.col(c).isNotNull() & (F.col(f"_hi_{c}") > F.col(f"_lo_{c}")), F.least(F.floor((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * bins), F.lit(bins - 1))) for c in names}
    binned = own.select(*[F.coalesce(e, F.lit(bins)).cast("int").alias(f"b{i}") for i, e in enumerate(cut.values())])  # the last bin holds nulls
    if len(pairs) > together:
        binned = materialise(binned)
    place, wide = {c: i for i, c in enumerate(names)}, bins + 1
    cells = None
    for first in range(0, len(pairs), together):
        part = pairs[first : first + together]

        def histograms(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((len(part), wide * wide), dtype=np.int64)
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                for i, (a, b) in enumerate(part):
                    seen[i] += np.bincount(columns[place[a]] * wide + columns[place[b]], minlength=wide * wide)
            at, cell = np.nonzero(seen)
            x, y = cell // wide, cell % wide
            whole = (x < bins) & (y < bins)
            out = [at[whole].astype(np.int32), x[whole].astype(np.int32), y[whole].astype(np.int32), seen[at, cell][whole]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["pair", "x", "y", "c"])

        one = binned.mapInArrow(histograms, "pair int, x int, y int, c bigint").groupBy("pair", "x", "y").agg(F.sum("c").alias("c")).withColumn("pair", F.col("pair") + first)
        cells = one if cells is None else cells.unionByName(one)
    # entropies follow from counts, log n less the sum of c log c over n, so that totals need no join
    entropy = lambda c: F.log(F.sum(c)) - F.sum(F.col(c) * F.log(c)) / F.sum(c)
    joint = cells.groupBy("pair").agg(F.sum("c").alias("n"), entropy("c").alias("hxy"))
    sides = [cells.groupBy("pair", v).agg(F.sum("c").alias("c")).groupBy("pair").agg(entropy("c").alias(f"h{v}")) for v in ("x", "y")]
    top = F.greatest("hx", "hy")
    value = F.when((F.col("n") >= least) & (top > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("hx") + F.col("hy") - F.col("hxy")) / top))).otherwise(0.0)
    out = joint.join(sides[0], "pair").join(sides[1], "pair").select("pair", value.alias("nmi"))
    every = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return every.join(out, "pair", "left").select("a", "b", F.coalesce("nmi", F.lit(0.0)).alias("nmi"))


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred products) of the complete rows, from partial sums of each partition. The matrix has one entry for each pair of
    columns and is the only thing that comes to the driver."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    means = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).first()
    n = means["n"]
    if not n:
        return 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
    mu = np.array([means[c] for c in columns])

    def add(batches):
        total = np.zeros((len(columns), len(columns)))
        for g in batches:
            x = g.to_numpy(float) - mu
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(len(columns)), len(columns)), "j": np.tile(np.arange(len(columns)), len(columns)), "s": total.ravel()})

    out = np.zeros((len(columns), len(columns)))
    for r in rows.mapInPandas(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return n, mu, out


def correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    n, _, s = gram(df, columns)
    d = np.sqrt(np.clip(np.diag(s), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(s / np.outer(d, d)) if n else s
