"""Mixing sources to target weights by entropy balancing.

Rates r of documents that keep every source's token target, come near the targets of further margins, and stay as close as they can to one
copy each, in relative entropy by token, have the form r = exp(sum of the multipliers of the document's margins), cut at `most`. The
multipliers solve the convex dual, in which further margins have a quadratic penalty, so that it has a solution whatever their targets; its
gradient and Hessian are sums over the documents, which Spark takes in one job for each Newton iteration. Rates are then rounded to whole
copies, group by group, each document carrying over what the rounding of the larger ones left. Equal rows are one row with a count until
they are dealt their copies, so none of them makes a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import materialise, sized, words

#: Documents to a group in which rates are rounded together; rows that one expansion of a repeated row gives.
GROUP, REPEATS = 2_000, 1_000


def sizes(docs: DataFrame, keep: tuple[str, ...], text: str = "text", key: str = "doc_id", h: Column | None = None) -> DataFrame:
    """doc_id, the kept columns, size (words of the text, null: 0) and h, a hash of key and text that orders documents."""
    return docs.select(
        F.col(key).alias("doc_id"), *[F.col(c) for c in keep], F.size(words(F.coalesce(text, F.lit("")))).cast("long").alias("size"), (F.xxhash64(key, text) if h is None else h).alias("h")
    )


def size_class(size: Column) -> Column:
    """The number of binary digits of a size: 0, 1, 2-3, 4-7, ..."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double"))) + 1).otherwise(0).cast("int")


def target_shares(totals: dict[str | None, int], weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> dict[str | None, float]:
    """Tokens for each source: all tokens by weight, sources by code point and null last, the weights repeating; a share over `most`
    times the source's own tokens is cut there, and the rest is shared again."""
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(sum(totals.values())), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > most * totals[s]]
        if not over:
            out |= {s: weight[s] * unit for s in free}
            break
        for s in over:
            out[s] = most * totals[s]
            left -= out[s]
            free.remove(s)
        left = max(left, 0.0)
    return out


def multipliers(rows: DataFrame, targets: dict[str, dict], most: float = 3.0, penalty: float = 0.0, tolerance: float = 1e-9, iterations: int = 60) -> dict[str, dict]:
    """For each margin (a column name) and value, the dual variable. rows: the margins' columns and size. targets: tokens by margin and
    value; margins are catalogues such as sources or classes, and their values' number bounds what comes to the driver. The first margin's
    targets are met exactly, those of the others but for `penalty` times target and multiplier."""
    margins = list(targets)
    place = {(m, v): i for i, (m, v) in enumerate((m, v) for m in margins for v in targets[m])}
    goal = np.array([targets[m][v] for m in margins for v in targets[m]], float)
    soft = np.array([0.0 if m == margins[0] else penalty * max(t, 1.0) for m in margins for t in targets[m].values()])
    cells = materialise(rows.where("size > 0").groupBy(*margins).agg(F.sum("size").alias("tokens")))
    at, top = np.zeros(len(goal)), np.log(most)

    def partial(batches: Iterator[pd.DataFrame], at: np.ndarray) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                own = [place[m, None if pd.isna(v) else v] for m, v in zip(margins, row[:-1], strict=True)]
                power = float(sum(at[i] for i in own))
                mass = row[-1] * np.exp(min(power, top))
                free = mass if power < top else 0.0  # a rate that is cut does not move with the multipliers
                for i in own:
                    for j in own:
                        total[i, j] = total.get((i, j), 0.0) + np.array([mass if i == j else 0.0, free])
        yield pd.DataFrame([(i, j, float(x[0]), float(x[1])) for (i, j), x in total.items()], columns=["i", "j", "mass", "free"])

    def sums(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mass, free = np.zeros(len(goal)), np.zeros((len(goal), len(goal)))
        made = cells.mapInPandas(lambda b: partial(b, at), "i int, j int, mass double, free double").groupBy("i", "j").agg(F.sum("mass").alias("mass"), F.sum("free").alias("free"))
        for r in made.collect():
            free[r["i"], r["j"]] = r["free"]
            if r["i"] == r["j"]:
                mass[r["i"]] = r["mass"]
        return mass + soft * at - goal, free

    for _ in range(iterations):
        gradient, free = sums(at)
        if np.abs(gradient).max(initial=0) <= tolerance * max(1.0, goal.sum()):
            break
        hessian = free + np.diag(soft + 1e-9 * np.maximum(1.0, goal))
        step = np.linalg.lstsq(hessian, -gradient, rcond=None)[0]
        at = np.clip(at + np.clip(step, -1, 1), -30, 30)
    return {m: {v: float(at[place[m, v]]) for v in targets[m]} for m in margins}


def rounded(rows: DataFrame, kind: str, most: float) -> DataFrame:
    """Adds copies, of all equal rows together. rows: doc_id, size, h, times (equal rows), rate, grp (a key of groups of about GROUP rows), other
    columns. In a group documents go from the largest to the smallest; a document gets its rate rounded down or up, by its hash and by the
    tokens still owed or overdrawn. Once the smaller ones could not settle these by rounding, a document may go one copy further, from
    none to `most` a row."""

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "h"], ascending=[False, True], kind="stable")
        u = (g["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) / float(1 << 53)
        out, owed = np.zeros(len(g), np.int64), 0.0
        whole = g["size"] * g["times"]
        behind = (whole.sum() - whole.cumsum()).tolist()
        for i, (size, times, rate, v, rest) in enumerate(zip(g["size"].tolist(), g["times"].tolist(), g["rate"].tolist(), u.tolist(), behind, strict=True)):
            if size:
                want, limit = rate * times, int(most) * times
                low = int(want + 1e-9)
                part = want - low
                copies = low + (part + owed / size > v if part > 1e-9 else 0)
                after = owed + (want - copies) * size
                if after > max((1 - part) * rest, size / 2) and copies + 1 <= limit:
                    copies += 1
                elif after < -max(part * rest, size / 2) and copies > 0:
                    copies -= 1
                out[i] = copies
                owed += (want - copies) * size
        return g.assign(copies=out)

    return rows.groupBy("grp").applyInPandas(spread, kind)


def copies_of(
    docs: DataFrame, targets: dict[str, dict] | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, penalty: float = 0.5, source: str = "source", key: str = "doc_id", text: str = "text", h: Column | None = None
) -> DataFrame:
    """A row for each distinct row (doc_id, source, size, h) of docs: doc_id, h, source, size, source_size, target, times (how many rows it
    stands for) and copies, of all these together. Arguments as for `mix`; h: another hash to tell rows apart."""
    margins = ["source", *[m for m in targets or {} if m != "source"]] if targets else ["source", "size_class"]
    given = [m for m in margins if m not in ("source", "size_class")]
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), *[F.col(m) for m in given], (F.xxhash64(key, text) if h is None else h).alias("_h"))
    rows = sizes(own, ("source", *given), h=F.col("_h")).withColumn("size_class", size_class(F.col("size")))
    keys = ["doc_id", "h", "size", *dict.fromkeys(["source", *margins])]
    rows = materialise(rows.groupBy(*keys).agg(F.count("*").alias("times")))
    totals = {r["source"]: (r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("size"), F.count("*").alias("n")).collect()}
    shares = target_shares({s: n for s, (n, _) in totals.items()}, weights, most)
    if not targets:
        classes = {r["size_class"]: r["size"] for r in rows.where("size > 0").groupBy("size_class").agg(F.sum(F.col("size") * F.col("times")).alias("size")).collect()}
        scale = sum(shares.values()) / max(1, sum(classes.values()))
    goals = targets or {"source": {s: t for s, t in shares.items() if totals[s][0] > 0}, "size_class": {c: n * scale for c, n in classes.items()}}
    dual = multipliers(rows.withColumn("size", F.col("size") * F.col("times")), {m: goals[m] for m in sorted(goals, key=lambda m: m != "source")}, most, penalty)
    spark = docs.sparkSession
    rated, kinds = rows, dict(rows.dtypes)
    for m in goals:
        table = spark.createDataFrame([(v, x) for v, x in dual[m].items()], f"_v_{m} {kinds[m]}, _l_{m} double")
        rated = rated.join(sized(table), F.col(m).eqNullSafe(F.col(f"_v_{m}")), "left")
    rate = F.least(F.exp(sum((F.coalesce(F.col(f"_l_{m}"), F.lit(0.0)) for m in goals), F.lit(0.0))), F.lit(float(most)))
    by_source = spark.createDataFrame([(s, n, shares[s], -(-c // GROUP)) for s, (n, c) in totals.items()], f"_s {kinds['source']}, source_size long, target double, parts long")
    rated = rated.join(sized(by_source), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "source_size", "target", "h", "times", rate.alias("rate"), F.xxhash64("source", F.pmod(F.xxhash64("h"), F.col("parts"))).alias("grp")
    )
    kind = ", ".join(f"{c} {t}" for c, t in rated.dtypes) + ", copies long"
    return rounded(rated, kind, most).select(F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), "h", "source", "size", "source_size", "target", "times", "copies")


def mix(
    docs: DataFrame, targets: dict[str, dict] | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, penalty: float = 0.5, source: str = "source", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row for each row of docs: doc_id, h (a hash of key and text), source, size, source_size, target, copies (0 to `most`) and taken =
    copies * size.

    Without targets the margins are the source, with the tokens of `target_shares`, and the size class, whose shares of all tokens the mix
    keeps as far as `penalty` and the sources allow. Null sources are one source; null and empty texts have size 0 and no copies;
    documents without key are mixed as others; of repeated rows some may get a copy more than others. Equal inputs give equal results, in
    any partitioning; other columns are not read, whatever their names."""
    found = copies_of(docs, targets, weights, most, penalty, source, key, text)
    each = found.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))))
    each = each.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(REPEATS), F.col("times") - F.col("_a") * REPEATS) - 1)))
    extra = (F.col("_a") * REPEATS + F.col("_b") < F.pmod("copies", "times")).cast("long")
    dealt = each.withColumn("copies", F.expr("copies div times") + extra)
    return dealt.select("doc_id", "h", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
