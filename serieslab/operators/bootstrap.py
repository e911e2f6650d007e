"""Rank correlations of circular block resamples, from how often each row is in each round.

Of a series of up to `LOCAL_ROWS` rows a task takes some rounds: it reads the ranks as packed bytes, counts each row by the starts of the round's
blocks, and nothing is written down that has rows times rounds. Of a longer series a row carries an array with its count in every round, and
ranks in a round follow from sums of these arrays over values in order. Its tasks take blocks of rows, by place or by value, of about `CELLS`
counts; its tables are rows times rounds in size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.core import BUCKET, lengths, matched, materialise, sized, with_scalars

#: Counts (rows x rounds) of a block of rows.
CELLS = 1 << 19
#: Rows of a series up to which twice a rank fits into four bytes.
SHORT = 1 << 29
COUNTS = np.dtype("<u2")
#: Rows of a series up to which a task takes whole rounds, and how many: it holds about 60 bytes a row.
LOCAL_ROWS, ROUNDS_OF_TASK = 1 << 23, 50


def cells_of(column: pa.ChunkedArray, kind: str | np.dtype, rounds: int) -> np.ndarray:
    """Binary cells of equal length as a matrix with a row for each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, rounds)


def binary(cells: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(cells)], pa.binary())


def times_in_rounds(lo: np.ndarray, hi: np.ndarray, round_: np.ndarray, rows: int, rounds: int) -> np.ndarray:
    """(rows, rounds): how many of the ranges [lo, hi) of a round hold a row."""
    steps = np.zeros((rows + 1, rounds), np.int32)
    np.add.at(steps, (lo, round_), 1)
    np.add.at(steps, (hi, round_), -1)
    return np.cumsum(steps[:-1], axis=0).astype(COUNTS)


def double_ranks(code: np.ndarray, counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Twice the average rank in each round of rows whose values are in the order of `code`, `below` rows having lesser ones in other blocks."""
    _, place = np.unique(code, return_inverse=True)
    by_value = np.zeros((place.max() + 1, counts.shape[1]), np.int64)
    np.add.at(by_value, place, counts)
    return (2 * (below + np.cumsum(by_value, axis=0) - by_value) + by_value + 1)[place]


def dealt(code: Column, same: Column, idx: Column, width: int) -> Column:
    """(block, part) of a row by its average rank in the series. A value of more than `width` rows has a block of its own, in parts by place;
    the rest of a block has at most twice `width` rows. Hot values lie more than `width` ranks apart and cover their middle, so a block has at
    most one, and its other values are all below it or all above."""
    hot = same > width
    return F.struct((2 * F.floor(code / width) + hot.cast("long")).alias("block"), F.when(hot, F.floor(idx / width)).otherwise(F.lit(0).cast("long")).alias("part"))


def totals_below(counted: DataFrame, key: str, code: str, rounds: int) -> DataFrame:
    """(series, block, part, below, total): for each block of values, its rows in each round and those of the blocks before it."""

    def added(t: pa.Table) -> pa.Table:
        total = cells_of(t["m"], COUNTS, rounds).sum(axis=0, dtype=np.int64)
        return t.slice(0, 1).select(["series", "block", "part"]).append_column("least", pa.array([t[code].to_numpy().min()])).append_column("total", pa.array([total.tolist()], pa.list_(pa.int64())))

    kind = dict(counted.dtypes)["series"]
    parts = counted.select("series", f"{key}.block", f"{key}.part", code, "m").groupBy("series", "block", "part")
    parts = materialise(parts.applyInArrow(added, f"series {kind}, block long, part long, least double, total array<long>"))
    each = parts.select("series", "block", "least", F.posexplode("total").alias("round", "n"))
    whole = each.groupBy("series", "block", "round").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    before = Window.partitionBy("series", "round").orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    by_round = F.sort_array(F.collect_list(F.struct("round", "before", "n")))
    arrays = whole.groupBy("series", "block").agg(by_round.alias("_r"))
    arrays = arrays.select("series", "block", F.col("_r.before").alias("below"), F.col("_r.n").alias("total"))
    return matched(parts.select("series", "block", "part"), arrays, ["series", "block"])


def ranked_in_rounds(counted: DataFrame, key: str, code: str, rounds: int, made: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What `made` gives for each block of rows and twice their ranks in every round."""

    def run(rows: pa.Table, facts: pa.Table) -> pa.Table:
        counts = cells_of(rows["m"], COUNTS, rounds)
        below, total = (np.array(facts[c][0].as_py(), np.int64) for c in ("below", "total"))
        if facts["block"][0].as_py() % 2:  # one value, of which other tasks hold further rows
            ranks = np.broadcast_to(2 * below + total + 1, counts.shape)
        else:
            ranks = double_ranks(rows[code].to_numpy(), counts, below)
        return made(rows, ranks)

    rows = counted.withColumns({"block": F.col(f"{key}.block"), "part": F.col(f"{key}.part")}).drop(key)
    facts = totals_below(counted, key, code, rounds)
    keys = ["series", "block", "part"]
    return rows.groupBy(*keys).cogroup(facts.groupBy(*keys)).applyInArrow(run, schema)


def starts_of_rounds(sizes: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(series, n, b, round, _s): the first rows of resampled blocks, from (series, n, b). They come from a hash of series, round and number, so
    reruns agree."""
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = sizes.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).repartition(tasks, "series", "round")
    each = each.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / F.col("b")).cast("int") - 1)))
    return each.withColumn("_s", F.pmod(F.xxhash64("series", "round", "_k", F.lit(seed)), F.col("n")))


def block_starts(sizes: DataFrame, rounds: int, seed: int, width: int) -> DataFrame:
    """(series, bucket, lo, hi, round): the pieces of resampled blocks inside buckets of `width` rows; a block that passes the end goes on at the
    start."""
    each = starts_of_rounds(sizes, rounds, seed).withColumn("_e", F.col("_s") + F.col("b"))
    pieces = F.array(F.struct(F.col("_s").alias("lo"), F.least("_e", "n").alias("hi")), F.struct(F.lit(0).cast("long").alias("lo"), (F.col("_e") - F.col("n")).alias("hi")))
    each = each.withColumn("_p", F.explode(pieces)).where("_p.hi > _p.lo")
    each = each.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("_p.lo") / width), F.floor((F.col("_p.hi") - 1) / width))))
    inside = lambda c: F.least(F.greatest(F.col(f"_p.{c}") - F.col("bucket") * width, F.lit(0)), F.lit(width)).cast("int").alias(c)
    return each.select("series", "bucket", inside("lo"), inside("hi"), "round")


def times_of_rows(starts: np.ndarray, b: int, n: int) -> np.ndarray:
    """How many of the circular blocks of b rows hold each of n rows."""
    ends = starts + b
    over = ends[ends > n] - n
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(np.concatenate([np.minimum(ends, n), over]), minlength=n + 1)
    steps[0] += len(over)
    return np.cumsum(steps[:-1])


def sums_of_rounds(y: np.ndarray, p: np.ndarray, starts: np.ndarray, round_: np.ndarray, b: int) -> tuple[np.ndarray, list[tuple[float, float, float]]]:
    """(rounds, sums of yy, pp and yp) of twice the ranks in each round, less their mean, from numbers in the order of both values."""
    (y, p), n = (np.unique(v, return_inverse=True)[1] for v in (y, p)), len(y)
    order = np.argsort(round_, kind="stable")
    found, first = np.unique(round_[order], return_index=True)
    sums = []
    for own in np.split(starts[order], first[1:]):
        m = times_of_rows(own, b, n).astype(float)
        mean, ranks, squares = len(own) * b + 1, [], []
        for code in (y, p):
            count = np.bincount(code, m)
            twice = 2 * np.cumsum(count) - count + 1 - mean
            ranks.append(twice[code])
            squares.append(float(count @ (twice * twice)))
        sums.append((*squares, float((m * ranks[0]) @ ranks[1])))
    return found, sums


def _sums_in_tasks(rows: DataFrame, sizes: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(series, round, yy, pp, yp) of series of up to `LOCAL_ROWS` rows. Their ranks are packed by bucket, and read once for each of the groups
    of rounds."""
    kind = dict(rows.dtypes)["series"]

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        packed = [pa.array([np.rint(2 * t[c].to_numpy()).astype("<i4").tobytes()], pa.binary()) for c in ("ry", "rp")]
        return pa.Table.from_arrays([*t.slice(0, 1).select(["series", "bucket"]).columns, *packed], ["series", "bucket", "y", "p"])

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        y, p = (np.frombuffer(b"".join(t[c].to_pylist()), "<i4") for c in ("y", "p"))
        found, sums = sums_of_rounds(y, p, s["_s"].to_numpy(), s["round"].to_numpy(), s["b"][0].as_py())
        series = pa.array([s["series"][0].as_py()] * len(found), s.schema.field("series").type)
        return pa.table({"series": series, "round": pa.array(found, pa.int32()), **{c: pa.array(v, pa.float64()) for c, v in zip(("yy", "pp", "yp"), zip(*sums, strict=True), strict=True)}})

    own = matched(rows, sizes.select("series"), "series", "left_semi").select("series", F.floor(F.col("idx") / BUCKET).alias("bucket"), "idx", "ry", "rp")
    packed = materialise(own.groupBy("series", "bucket").applyInArrow(pack, f"series {kind}, bucket long, y binary, p binary"))
    spread = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // ROUNDS_OF_TASK))))
    starts = starts_of_rounds(sizes, rounds, seed).select("series", F.floor(F.col("round") / ROUNDS_OF_TASK).cast("int").alias("group"), "round", "b", "_s")
    return spread.groupBy("series", "group").cogroup(starts.groupBy("series", "group")).applyInArrow(run, f"series {kind}, round int, yy double, pp double, yp double")


def resampled_ics(rows: DataFrame, rounds: int, block: int | None = None, seed: int = 42, width: int | None = None) -> DataFrame:
    """(series, round, ic): rank correlation of every resample, null where one side is constant in it, from (series, idx dense from 0, ry, ny,
    rp, np): the average ranks of both values in the series and the number of rows that share them.

    A round takes floor(n / b) blocks of b = `block` rows, or the greater of 20 and 1.5 times the cube root of n. Series under ten blocks have
    no rounds. Series of up to `LOCAL_ROWS` rows take whole rounds in a task. `width` is the number of rows of a task for longer ones, from
    `CELLS` if not given; where it is given, all series are taken as longer ones."""
    sizes = lengths(rows).withColumn("b", F.lit(block).cast("long") if block else F.greatest(F.lit(20), F.round(1.5 * F.pow("n", F.lit(1 / 3)))).cast("long"))
    sizes = materialise(sizes.where("n >= 10 * b"))
    short, long = sizes.where(F.col("n") <= (-1 if width else LOCAL_ROWS)), sizes.where(F.col("n") > (-1 if width else LOCAL_ROWS))
    sums = _sums_in_tasks(rows, sized(short), rounds, seed)
    if long.limit(1).count():
        blocks = _sums_in_blocks(rows, sized(long), rounds, seed, width or max(50, CELLS // rounds))
        sums = blocks if width else sums.unionByName(blocks)
    both = (F.col("yy") > 0) & (F.col("pp") > 0)
    ic = F.when(both, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("yp") / F.sqrt("yy") / F.sqrt("pp"))))
    return sums.select("series", "round", ic.alias("ic"))


def _sums_in_blocks(rows: DataFrame, sizes: DataFrame, rounds: int, seed: int, width: int) -> DataFrame:
    """(series, round, yy, pp, yp) of series of any length, by blocks of `width` rows."""
    kind = dict(rows.dtypes)["series"]
    own = with_scalars(rows, sizes).withColumns({
        "bucket": F.floor(F.col("idx") / width), "by_y": dealt(F.col("ry"), F.col("ny"), F.col("idx"), width), "by_p": dealt(F.col("rp"), F.col("np"), F.col("idx"), width),
        "size": F.floor(F.col("n") / F.col("b")) * F.col("b"),
    }).select("series", "idx", "bucket", "size", "n", "ry", "rp", "by_y", "by_p")

    def counted(r: pa.Table, s: pa.Table) -> pa.Table:
        m = times_in_rounds(s["lo"].to_numpy(), s["hi"].to_numpy(), s["round"].to_numpy(), width, rounds)
        return r.append_column("m", binary(m[r["idx"].to_numpy() % width])).drop_columns(["idx", "bucket"])

    place = "struct<block: bigint, part: bigint>"
    starts = block_starts(sizes, rounds, seed, width)
    once = own.groupBy("series", "bucket").cogroup(starts.groupBy("series", "bucket"))
    once = once.applyInArrow(counted, f"series {kind}, size long, n long, ry double, rp double, by_y {place}, by_p {place}, m binary")
    # buckets that no start reaches do not leave empty cells: cogroup gives them no ranges, hence counts of zero
    once = materialise(once)

    def with_ranks(r: pa.Table, ranks: np.ndarray) -> pa.Table:
        short = r["n"][0].as_py() < SHORT
        return r.select(["series", "size", "rp", "by_p", "m"]).append_column("short", pa.array([short] * len(r))).append_column("twice", binary(ranks.astype("<i4" if short else "<i8")))

    said = ranked_in_rounds(once, "by_y", "ry", rounds, with_ranks, f"series {kind}, size long, rp double, by_p {place}, m binary, short boolean, twice binary")
    said = materialise(said)

    def products(r: pa.Table, ranks: np.ndarray) -> pa.Table:
        m = cells_of(r["m"], COUNTS, rounds).astype(float)
        mean = r["size"][0].as_py() + 1
        y = cells_of(r["twice"], "<i4" if r["short"][0].as_py() else "<i8", rounds) - float(mean)
        p = ranks - float(mean)
        sums = [(m * u * v).sum(axis=0) for u, v in ((y, y), (p, p), (y, p))]
        out = pa.table({"round": pa.array(np.arange(rounds, dtype=np.int32)), "yy": sums[0], "pp": sums[1], "yp": sums[2]})
        return out.add_column(0, "series", pa.array([r["series"][0].as_py()] * rounds, r["series"].type))

    sums = ranked_in_rounds(said, "by_p", "rp", rounds, products, f"series {kind}, round int, yy double, pp double, yp double")
    return sums.groupBy("series", "round").agg(*[F.sum(c).alias(c) for c in ("yy", "pp", "yp")])
