"""Gradient boosting of symmetric trees over quantile bins.

Columns become bin numbers once; from then on rows travel as blocks of bytes, sorted by bins and target: rows that share both are one group,
whose gradients are worked out once and counted as often as its rows are drawn, so copies of rows cost their draw only. Every level of a tree takes the sums of gradients and Hessians by
(node, feature, bin) and the split that all nodes of the level share is the one with the highest sum of G^2 / (H + l2). Gradients are whole
multiples of a power of two, small enough for their sums to be exact, so trees do not depend on how rows are partitioned or added up.

All folds of a plan grow side by side. A row carries two sets of bits, the folds in which it is learnt from and those in which it checks, so
folds are filters and rows are not copied. Where the blocks are few (a checked size) each fold is grown by one task, in one job; beyond it
each level is one job over all blocks for all folds, and only the best split of each feature reaches the driver. Both run the same steps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.core import materialise, unpivoted, value_ranks

#: Cells (groups of equal rows times features) and rows up to which one task grows a fold; rounds between writes of the scores beyond these;
#: classes of a target.
LOCAL_CELLS, LOCAL_ROWS, WRITE_EVERY, CLASSES = 192 << 20, 40 << 20, 20, 1_000
#: Cells that are counted at a time; groups and rows that a task treats at a time; keys that are hashed at a time.
CHUNK, PIECE_GROUPS, PIECE_ROWS, PIECE_KEYS = 2 << 20, 128 << 10, 2 << 20, 64 << 10


@dataclass(frozen=True)
class Settings:
    """The defaults are the parameters in force."""

    rounds: int = 750
    rate: float = 0.025
    depth: int = 6
    l2: float = 10.0
    subsample: float = 0.7
    patience: int = 100
    bins: int = 128
    seed: int = 42


@dataclass
class Tree:
    """`features` and `cuts` by level; leaf number: bit i is set where the bin of the i-th feature is over its cut. values: leaves x classes."""

    features: list[int]
    cuts: list[int]
    values: np.ndarray
    weights: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        kind = np.uint8 if len(self.cuts) <= 8 else np.int64
        out = np.zeros(x.shape[1], kind)
        for i, (f, c) in enumerate(zip(self.features, self.cuts, strict=True)):
            over = (x[f] > c).view(np.uint8).astype(kind, copy=False)
            out |= np.left_shift(over, kind(i), out=over)
        return out

    def add_to(self, score: np.ndarray, x: np.ndarray) -> None:
        """Adds the leaves' values to the scores (rows x classes)."""
        at = self.leaves(x)
        for k, v in enumerate(self.values.T):
            score[:, k] += np.take(v, at)


@dataclass
class Ensemble:
    """A fitted ensemble: of the classes `labels`, or of numbers where there are none. metrics: by part (train, check) and name."""

    columns: list[str]
    borders: list[list[float]]
    labels: list[float]
    base: list[float]
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)

    def importances(self) -> dict[str, float]:
        """How much the predictions change when a feature's splits change sides: over pairs of leaves that one split tells apart, the
        weighted squares of their values around the pair's mean; in percent of all."""
        out = np.zeros(len(self.columns))
        for t in self.trees:
            at = np.arange(len(t.weights))
            for i, f in enumerate(t.features):
                low = at[(at >> i) & 1 == 0]
                a, b, v, w = t.weights[low], t.weights[low | 1 << i], t.values[low], t.values[low | 1 << i]
                share = np.divide(a * b, a + b, out=np.zeros_like(a), where=a + b > 0)
                out[f] += float((share[:, None] * (v - w) ** 2).sum())
        total = out.sum()
        return dict(zip(self.columns, (100 * out / total if total > 0 else out).tolist(), strict=True))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.repeat(np.array([self.base]), x.shape[1], axis=0)
        for t in self.trees:
            t.add_to(out, x)
        return out

    def to_json(self) -> str:
        trees = [{"features": t.features, "cuts": t.cuts, "values": t.values.tolist(), "weights": t.weights.tolist()} for t in self.trees]
        return json.dumps({"columns": self.columns, "borders": self.borders, "labels": self.labels, "base": self.base, "trees": trees, "losses": self.losses, "metrics": self.metrics})

    @staticmethod
    def from_json(text: str) -> Ensemble:
        d = json.loads(text)
        trees = [Tree(t["features"], t["cuts"], np.array(t["values"]), np.array(t["weights"])) for t in d.pop("trees")]
        return Ensemble(trees=trees, **d)


def to_bins(values: np.ndarray, borders: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(borders), values, "left").astype(np.uint8)


@dataclass
class Block:
    """Some groups of equal rows: bins (features x groups) and target (class numbers or values); of their rows, group after group, the key and by
    fold whether a row is learnt from or checks. starts: the first row of each group; None where each row is a group."""

    x: np.ndarray
    y: np.ndarray
    key: np.ndarray
    train: np.ndarray | dict[int, np.ndarray]
    check: np.ndarray | dict[int, np.ndarray]
    upto: int = 0
    score: np.ndarray | None = None
    part: Part | None = None
    starts: np.ndarray | None = None
    checks: np.ndarray | None = None

    def times(self, rows: np.ndarray) -> np.ndarray:
        """How many of some rows (a mask) each group has."""
        if self.starts is None:
            return rows
        if len(rows) > 8 * len(self.starts):
            return np.add.reduceat(rows.view(np.uint8), self.starts, dtype=np.int32)
        run = np.concatenate([[0], np.cumsum(rows, dtype=np.int32)])  # quicker where groups are small
        return np.diff(run[self.starts], append=run[-1:])


@dataclass
class Part:
    """The groups of a block that a tree learns from, drawn once a tree: its number, their channels, times the rows drawn, and bins, and the nodes
    of the last level that was asked for."""

    tree: int
    weights: np.ndarray
    x: np.ndarray
    node: np.ndarray
    levels: int = 0


@dataclass
class Growth:
    """The state of one fold: the trees so far and the levels of the one that grows. outputs: numbers that a leaf gives; scale: the unit of
    gradients is 1 / scale; top: the bound of a gradient."""

    fold: int
    settings: Settings
    outputs: int
    regression: bool
    scale: float
    top: float
    base: list[float]
    trees: list[Tree] = field(default_factory=list)
    level: list[tuple[int, int]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    done: bool = False

    @property
    def width(self) -> int:
        """Sums that measure a part."""
        return 5 if self.regression else max(self.outputs, 2) ** 2

    def scored(self, b: Block) -> np.ndarray:
        if b.score is None:
            b.score = np.repeat(np.array([self.base]), b.x.shape[1], axis=0)
        for t in self.trees[b.upto :]:
            t.add_to(b.score, b.x)
        b.upto = len(self.trees)
        return b.score

    def chances(self, score: np.ndarray) -> np.ndarray:
        if self.outputs == 1:
            return 1 / (1 + np.exp(-score))
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def channels(self, b: Block) -> np.ndarray:
        """Gradients in whole units; of classes also Hessians and ones, of numbers both are one unit for every row."""
        score = self.scored(b)
        if self.regression:
            g = (score[:, 0] - b.y)[None]
            np.clip(g, -self.top, self.top, out=g)
            g *= self.scale
            return np.rint(g, out=g)
        p = self.chances(score)
        g, h = p - (b.y[:, None] if self.outputs == 1 else b.y[:, None] == np.arange(self.outputs)), p * (1 - p)
        return np.rint(np.concatenate([np.clip(g, -self.top, self.top), h, np.ones((len(score), 1))], axis=1) * self.scale).T

    def drawn(self, key: np.ndarray) -> np.ndarray:
        """Rows that this round learns from, by a hash of their keys and the round."""
        out, start = np.empty(len(key), bool), np.uint64((self.settings.seed * 1_000_003 + len(self.trees) + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for first in range(0, len(key), PIECE_KEYS):
            z = key[first : first + PIECE_KEYS].view(np.uint64) + start
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z ^= z >> np.uint64(shift)
                z *= np.uint64(factor)
            z ^= z >> np.uint64(31)
            z >>= np.uint64(11)
            np.less(z, np.uint64(int(self.settings.subsample * 2**53)), out=out[first : first + PIECE_KEYS])
        return out

    def part(self, b: Block) -> Part:
        p = b.part
        kind = np.uint16 if self.settings.bins << self.settings.depth <= 1 << 16 else np.int64
        if p is None or p.tree != len(self.trees) or p.levels > len(self.level):
            drawn = self.drawn(b.key)
            drawn &= b.train[self.fold]
            times = b.times(drawn)
            rows = np.flatnonzero(times)
            weights = np.take(self.channels(b), rows, axis=1)
            if b.starts is not None:
                times = times[rows]
                weights *= times
                weights = np.concatenate([weights, (times * self.scale)[None]]) if self.regression else weights
            p = b.part = Part(len(self.trees), weights, np.take(b.x, rows, axis=1), np.zeros(len(rows), kind))
        for i, (f, c) in enumerate(self.level[p.levels :], p.levels):
            p.node |= (p.x[f] > c).astype(kind) << kind(i)
        p.levels = len(self.level)
        return p

    def counted(self, x: np.ndarray, weights: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
        """features x channels x nodes x bins. A number's Hessian is one unit for every row: where groups are rows these are counted."""
        bins, at, alone = self.settings.bins, node * node.dtype.type(self.settings.bins), self.regression and len(weights) == 1
        out = np.empty((len(x), len(weights) + alone, nodes * bins))
        for f, own in enumerate(x):
            cell = (at + own).astype(np.intp)
            for i, w in enumerate(weights):
                out[f, i] = np.bincount(cell, w, nodes * bins)
            if alone:
                np.multiply(np.bincount(cell, minlength=nodes * bins), self.scale, out=out[f, 1])
        return out.reshape(len(x), -1, nodes, bins)

    def histograms(self, b: Block) -> np.ndarray:
        """features x channels x nodes x bins: what the level's nodes hold of a block."""
        p = self.part(b)
        return self.counted(p.x, p.weights, p.node, 1 << len(self.level))

    def level_sums(self, blocks: list[Block], before: np.ndarray | None) -> np.ndarray:
        """The histograms of all blocks, given those of the level before: the smaller side of its split is counted, the other is the rest. Sums
        are whole numbers, so this is exact."""
        if before is None:
            return sum(self.histograms(b) for b in blocks)
        i, nodes, parts = len(self.level) - 1, before.shape[2], [self.part(b) for b in blocks]
        high = sum(int((p.node >> i).sum()) for p in parts)
        side = int(2 * high <= sum(len(p.node) for p in parts))
        total = np.zeros_like(before)
        for p in parts:
            rows = np.flatnonzero(p.node >> i == side)
            total += self.counted(np.take(p.x, rows, axis=1), np.take(p.weights, rows, axis=1), p.node[rows] & p.node.dtype.type(nodes - 1), nodes)
        return np.concatenate([before - total, total] if side else [total, before - total], axis=2)

    def loss(self, b: Block) -> tuple[int, int]:
        """(sum in units of 2^-20, rows) of the squared errors, or of minus the log of the true class's chance, over the checking rows."""
        score = self.scored(b)
        if b.checks is None:
            b.checks = b.times(b.check[self.fold])
        rows = np.flatnonzero(b.checks)
        score, y, times = score[rows], b.y[rows], b.checks[rows]
        if self.regression:
            each = (score[:, 0] - y) ** 2
        else:
            p = self.chances(score)
            each = -np.log(np.maximum(np.where(y == 1, p[:, 0], 1 - p[:, 0]) if self.outputs == 1 else p[np.arange(len(y)), y.astype(int)], 1e-300))
        return int((np.rint(each * 2**20) * times).sum()), int(times.sum())

    def best(self, h: np.ndarray) -> tuple[float, int, int, np.ndarray]:
        """(score, feature, cut, channels x nodes x 2) of the best split, from the sums of features (features x channels x nodes x bins)."""
        out, k, first = [], self.outputs, 0
        for part in np.array_split(h, -(-h.size // CHUNK) or 1):
            left = np.cumsum(part, axis=3)
            left /= self.scale
            right = left[..., -1:] - left
            score = np.zeros((len(part), part.shape[3]))
            for side in (left, right):
                for i in range(k):
                    gain = side[:, k + i] + self.settings.l2
                    np.divide(side[:, i], gain, out=gain)
                    gain *= side[:, i]
                    score += gain.sum(axis=1)
            score = score[:, :-1]
            f, c = np.unravel_index(score.argmax(), score.shape)
            out.append((float(score[f, c]), first + int(f), int(c), np.stack([left[f, :, :, c], right[f, :, :, c]], axis=2)))
            first += len(part)
        return max(out, key=lambda b: (b[0], -b[1]))

    def advance(self, score: float, f: int, cut: int, sums: np.ndarray) -> None:
        """Takes the level's best split; with the last level, or when no split tells rows apart any more, the tree is added."""
        whole, k = sums.sum(axis=2), self.outputs
        now = float((whole[:k] ** 2 / (whole[k : 2 * k] + self.settings.l2)).sum(axis=0).sum(axis=0))
        grows = score > now * (1 + 1e-12)
        if grows:
            self.level.append((f, cut))
            whole = np.concatenate([sums[:, :, 0], sums[:, :, 1]], axis=1)
        if not grows or len(self.level) == self.settings.depth:
            values = -self.settings.rate * whole[:k] / (whole[k : 2 * k] + self.settings.l2)
            self.trees.append(Tree([f for f, _ in self.level], [c for _, c in self.level], values.T.copy(), whole[-1].copy()))
            self.level = []
            self.done = len(self.trees) >= self.settings.rounds and not self.patient()

    def patient(self) -> bool:
        return bool(self.losses) and self.settings.patience > 0

    def judge(self, total: int, n: int) -> None:
        """Takes the checking rows' loss of the trees so far; ends after `patience` rounds without a gain, or with the last round."""
        if n:
            self.losses.append(total / 2**20 / n)
            stale = len(self.losses) - 1 - int(np.argmin(self.losses)) >= self.settings.patience > 0
            self.done = stale or len(self.trees) >= self.settings.rounds
        else:
            self.done = len(self.trees) >= self.settings.rounds
        if self.done and self.losses and self.settings.patience > 0:
            self.trees = self.trees[: int(np.argmin(self.losses))]

    def measured(self, b: Block) -> np.ndarray:
        """By part (train, check): for numbers n, sums of y, y^2, squared and absolute errors; for classes the confusion matrix."""
        score = self.scored(b)
        said = score[:, 0] if self.regression else (score[:, 0] > 0).astype(int) if self.outputs == 1 else score.argmax(axis=1)
        out = []
        for part in (b.train[self.fold], b.check[self.fold]):
            times, y, p = b.times(part), b.y, said
            n = max(self.outputs, 2)
            sums = lambda: [times.sum(), *((v * times).sum() for v in (y, y**2, (y - p) ** 2, np.abs(y - p)))]  # noqa: B023, E731
            out.append(np.array(sums(), float) if self.regression else np.bincount(y.astype(int) * n + p, times, minlength=n * n))
        return np.stack(out)

    def metrics(self, sums: np.ndarray) -> dict[str, dict[str, float]]:
        out = {}
        for name, s in zip(("train", "check"), sums, strict=True):
            n = s[0] if self.regression else s.sum()
            if not n:
                continue
            if self.regression:
                total = s[2] - s[1] ** 2 / n
                out[name] = {"n": float(n), "mse": float(s[3] / n), "mae": float(s[4] / n), "rmse": float(np.sqrt(s[3] / n)), "r2": float(1 - s[3] / total) if total > 0 else 0.0}
            else:
                m = s.reshape(max(self.outputs, 2), -1)
                hit, true, said = np.diag(m), m.sum(axis=1), m.sum(axis=0)
                pr, re = (np.divide(hit, x, out=np.zeros_like(hit), where=x > 0) for x in (said, true))
                f1 = np.divide(2 * pr * re, pr + re, out=np.zeros_like(hit), where=pr + re > 0)
                out[name] = {"n": float(n), "accuracy": float(hit.sum() / n)} | {k: float((v * true).sum() / n) for k, v in (("precision", pr), ("recall", re), ("f1", f1))}
        return out


def borders_of(rows: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """For each column the values that end its bins, but for the last: exact quantiles of all rows, at most bins - 1 a column."""
    ranks = materialise(value_ranks(unpivoted(rows, columns, ()), "value", ["feature"]))
    total = ranks.groupBy("feature").agg(F.sum("n").alias("total"))
    place = lambda c: F.floor(c * bins / F.col("total"))
    ends = ranks.join(F.broadcast(total), "feature").where((place(F.col("below")) != place(F.col("below") + F.col("n"))) & (F.col("below") + F.col("n") < F.col("total")))  # one row a column
    found: dict[str, list[float]] = {c: [] for c in columns}
    for r in ends.select("feature", "value").collect():  # bins numbers a column
        found[r["feature"]].append(float(r["value"]))
    return [sorted(found[c]) for c in columns]


def as_blocks(rows: DataFrame, columns: list[str], borders: list[list[float]], folds: int) -> DataFrame:
    """A row of bytes for every batch of rows: x and y of its groups of equal rows, size (rows of each group), and by row key, train and check.
    Rows are dealt by ranges of bins, target and key and sorted there, so equal ones meet, however many there are."""
    flags = [c for c, _ in rows.dtypes if c.startswith(("train", "check"))]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            x = np.stack([to_bins(d.column(f"c{i}").to_numpy(zero_copy_only=False), b) for i, b in enumerate(borders)], axis=1)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]).buffers()[1]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(np.ascontiguousarray(x))]), *[d.column(c) for c in ("y", "key", *flags)]], ["x", "y", "key", *flags])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            if not len(d):
                continue
            x = np.frombuffer(b"".join(d.column("x").to_pylist()), np.uint8).reshape(len(d), -1)
            y = d.column("y").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1) | (y[1:] != y[:-1])]))
            size = np.diff(first, append=len(d)).astype(np.int32)
            bits = [np.concatenate([_bits(d.column(c).to_numpy()) for c in flags if c.startswith(part)])[:folds] for part in ("train", "check")]
            made = [np.ascontiguousarray(x[first].T), y[first], size, d.column("key").to_numpy(), *[np.packbits(b, axis=0) for b in bits]]
            yield pa.RecordBatch.from_arrays([pa.array([n]) for n in (len(d), len(first))] + [pa.array([v.tobytes()], pa.binary()) for v in made] + [pa.array([0], pa.int32()), pa.array([None], pa.binary())], ["n", "m", "x", "y", "size", "key", "train", "check", "upto", "score"])

    numbered = rows.select("y", "key", *flags, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    placed = numbered.mapInArrow(binned, f"x binary, y double, key long, {', '.join(f'{c} long' for c in flags)}")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the bytes are few, the passes over them many
    return placed.repartitionByRange(tasks, "x", "y", "key").sortWithinPartitions("x", "y").mapInArrow(pack, BLOCKS)


BLOCKS = "n long, m long, x binary, y binary, size binary, key binary, train binary, check binary, upto int, score binary"
#: Folds to a column of flags.
FLAGS = 62


def _bits(v: np.ndarray) -> np.ndarray:
    """Flags x rows of one column of flags."""
    return (v >> np.arange(FLAGS)[:, None] & 1).astype(bool)


def unpacked(row, folds: int, outputs: int, fold: int) -> Block:
    n, m = int(row.n), int(row.m)
    bits = [(np.frombuffer(b, np.uint8).reshape(-1, n)[fold // 8] >> (7 - fold % 8) & 1).astype(bool) for b in (row.train, row.check)]
    score = None if not isinstance(row.score, bytes) else np.frombuffer(row.score).reshape(folds, m, outputs)[fold].copy()
    starts = None if n == m else np.cumsum(np.append(0, np.frombuffer(row.size, np.int32)[:-1]))
    return Block(np.frombuffer(row.x, np.uint8).reshape(-1, m), np.frombuffer(row.y), np.frombuffer(row.key, np.int64), {fold: bits[0]}, {fold: bits[1]}, int(row.upto) if score is not None else 0, score, starts=starts)


def grown(growth: Growth, blocks: list[Block]) -> tuple[Growth, np.ndarray]:
    """A fold grown from all its blocks, and its measures."""
    sums = None
    while not growth.done:
        if not growth.level:
            sums = None
            losses = [growth.loss(b) for b in blocks]
            growth.judge(sum(s for s, _ in losses), sum(n for _, n in losses))
            if growth.done:
                break
        sums = growth.level_sums(blocks, sums)
        growth.advance(*growth.best(sums))
    for b in blocks:
        b.upto, b.score, b.part = 0, None, None
    return growth, sum((growth.measured(b) for b in blocks), np.zeros((2, growth.width)))


def of_fold(b: Block, fold: int) -> Block | None:
    """A block's groups and rows that a fold learns from or checks with."""
    used = b.train[fold] | b.check[fold]
    if not used.any():
        return None
    size = b.times(used)
    some = size > 0
    starts = None if b.starts is None else np.cumsum(np.append(0, size[some][:-1]))
    return Block(np.compress(some, b.x, axis=1), b.y[some], b.key[used], {fold: b.train[fold][used]}, {fold: b.check[fold][used]}, starts=starts)


def joined(blocks: list[Block], fold: int) -> Block:
    """Some blocks of a fold as one."""
    sizes = [np.diff(b.starts, append=len(b.key)) if b.starts is not None else np.ones(len(b.key), np.int64) for b in blocks]
    x, y, key, size = np.concatenate([b.x for b in blocks], axis=1), *(np.concatenate(v) for v in ([b.y for b in blocks], [b.key for b in blocks], sizes))
    flags = [{fold: np.concatenate([b[fold] for b in bs])} for bs in ([b.train for b in blocks], [b.check for b in blocks])]
    return Block(x, y, key, *flags, starts=None if len(y) == len(key) else np.cumsum(np.append(0, size[:-1])))


def _grow_in_tasks(blocks: DataFrame, starts: list[Growth]) -> list[tuple[Growth, np.ndarray]]:
    """A task for each fold, with the fold's rows; the groups and rows of all are below checked sizes. A task puts small blocks together to pieces
    that its processor keeps at hand."""
    import pickle

    folds, outputs = len(starts), starts[0].outputs

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole: dict[int, list[Block]] = {}
        waiting: dict[int, list[Block]] = {}
        for d in frames:
            for r in d.itertuples():
                fold = int(r.fold)
                b = of_fold(unpacked(r, folds, outputs, fold), fold)
                few = waiting.setdefault(fold, [])
                few += [b] if b else []
                if sum(len(b.y) for b in few) >= PIECE_GROUPS or sum(len(b.key) for b in few) >= PIECE_ROWS:
                    whole.setdefault(fold, []).append(joined(few, fold))
                    few.clear()
        for fold, few in waiting.items():
            own = whole.pop(fold, []) + ([joined(few, fold)] if few else [])
            yield pd.DataFrame({"fold": [fold], "made": [pickle.dumps(grown(starts[fold], own))]})

    spread = blocks.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).repartitionById(folds, F.col("fold"))
    made = {r["fold"]: pickle.loads(r["made"]) for r in spread.mapInPandas(fit, "fold int, made binary").collect()}
    return [made[i] for i in range(folds)]


def _grow_by_levels(blocks: DataFrame, starts: list[Growth]) -> list[tuple[Growth, np.ndarray]]:
    """A job for each level, over all folds that still grow. Each task adds up its blocks, each feature's sums of tasks meet in one task,
    which hands on that feature's best split; scores are written down every few rounds."""
    import pickle

    folds, outputs, written = len(starts), starts[0].outputs, 0
    live = [g for g in starts if not g.done]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        losses: dict[int, np.ndarray] = {}
        for d in frames:
            for row in d.itertuples():
                for g in live:
                    b = unpacked(row, folds, outputs, g.fold)
                    total[g.fold] = g.histograms(b) + total.get(g.fold, 0)
                    if not g.level:
                        losses[g.fold] = np.array(g.loss(b)) + losses.get(g.fold, 0)
        for fold, h in total.items():
            yield pd.DataFrame({"fold": fold, "feature": np.arange(len(h)), "sums": [x.tobytes() for x in h]})
        for fold, pair in losses.items():
            yield pd.DataFrame({"fold": [fold], "feature": [-1], "sums": [pair.astype(float).tobytes()]})

    def best(d: pd.DataFrame) -> pd.DataFrame:
        g = next(g for g in live if g.fold == d["fold"].iloc[0])
        whole = sum(np.frombuffer(s) for s in d["sums"])
        made = whole if d["feature"].iloc[0] < 0 else g.best(whole.reshape(1, 2 * outputs + (not g.regression), 1 << len(g.level), -1))
        return pd.DataFrame({"fold": d["fold"].iloc[:1], "feature": d["feature"].iloc[:1], "made": [pickle.dumps(made)]})

    while live:
        parts = blocks.mapInPandas(sums, "fold int, feature int, sums binary")
        found = parts.groupBy("fold", "feature").applyInPandas(best, "fold int, feature int, made binary").collect()  # a row for each fold and feature
        by = {(r["fold"], r["feature"]): pickle.loads(r["made"]) for r in found}
        for g in live:
            if not g.level:
                g.judge(*map(int, by[g.fold, -1]))
            if not g.done:
                f = max((i for fold, i in by if fold == g.fold and i >= 0), key=lambda i: (by[g.fold, i][0], -i))
                score, _, cut, sums_of = by[g.fold, f]
                g.advance(score, f, cut, sums_of)
        ended = [g for g in live if g.done]
        live = [g for g in live if not g.done]
        longest = max((len(g.trees) for g in live), default=0)
        if ended or longest >= written + WRITE_EVERY:
            blocks, written = _with_scores(blocks, live, folds, outputs), longest
    return _measured(blocks, starts)


def _with_scores(blocks: DataFrame, live: list[Growth], folds: int, outputs: int) -> DataFrame:
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            made, upto = [], []
            for row in d.itertuples():
                out = np.zeros((folds, int(row.m), outputs))
                for g in live:
                    out[g.fold] = g.scored(unpacked(row, folds, outputs, g.fold))
                made.append(out.tobytes())
                upto.append(max(len(g.trees) for g in live))
            yield d.assign(score=made, upto=upto)

    return materialise(blocks.mapInPandas(score, blocks.schema)) if live else blocks


def _measured(blocks: DataFrame, done: list[Growth]) -> list[tuple[Growth, np.ndarray]]:
    folds, outputs = len(done), done[0].outputs
    width = done[0].width

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, 2 * width))
        for d in frames:
            for row in d.assign(score=None).itertuples():
                total += np.stack([g.measured(unpacked(row, folds, outputs, g.fold)).ravel() for g in done])
        at = np.indices(total.shape).reshape(2, -1)
        yield pd.DataFrame({"fold": at[0], "cell": at[1], "value": total.ravel()})

    out = np.zeros((folds, 2 * width))
    for r in blocks.mapInPandas(measure, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).collect():
        out[r["fold"], r["cell"]] = r["value"]
    return [(g, m.reshape(2, width)) for g, m in zip(done, out, strict=True)]


def boost(df: DataFrame, y: str, columns: list[str], task: str = "regression", folds: list[tuple[Column, Column]] | None = None, local_cells: int = LOCAL_CELLS, **settings) -> list[Ensemble]:
    """An ensemble for each fold, a pair of conditions: rows to learn from, and rows whose loss ends the boosting (of the rounds up to the least
    loss the trees stay). Without folds one ensemble learns from all rows.

    Rows with a null or NaN in the target or a column are left out; other tasks than "regression" have classes, which are the target's
    distinct values. A fold without rows to learn from gives an ensemble without trees. df has series and idx, by which rows are drawn; rows
    that repeat them are drawn together."""
    s = Settings(**settings)
    if not columns:
        raise ValueError("no columns to learn from")
    if s.bins > 256:
        raise ValueError("bins are bytes: 256 at most")
    conditions = folds or [(F.lit(True), F.lit(False))]
    sets = range(0, len(conditions), FLAGS)
    bits = lambda i, first: reduce(add, [F.when(F.coalesce(c[i], F.lit(False)), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, c in enumerate(conditions[first : first + FLAGS])])
    flags = {f"{name}{first // FLAGS}": bits(i, first) for i, name in enumerate(("train", "check")) for first in sets}
    clean = df.dropna(subset=[*columns, y]).withColumns({"_sl_y": F.col(y).cast("double"), "_sl_key": F.xxhash64("series", "idx"), **{f"_sl_{n}": c for n, c in flags.items()}})
    rows = materialise(clean.select(F.col("_sl_y").alias("y"), F.col("_sl_key").alias("key"), *[F.col(f"_sl_{n}").alias(n) for n in flags], *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    own = [f"c{i}" for i in range(len(columns))]
    labels: list[float] = []
    if task != "regression":
        labels = sorted(r["y"] for r in rows.select("y").distinct().limit(CLASSES + 1).collect())
        if len(labels) > CLASSES:
            raise ValueError(f"more than {CLASSES} classes")
        rows = rows.withColumn("y", F.array_position(F.array(*map(F.lit, labels)), F.col("y")).cast("double") - 1) if labels else rows
    learnt = [F.getbit(F.col(f"train{i // FLAGS}"), F.lit(i % FLAGS)) == 1 for i in range(len(conditions))]
    facts = [F.count_if(c).alias(f"n{i}") for i, c in enumerate(learnt)] + [F.sum(F.when(c, F.col("y").cast("decimal(38,12)"))).alias(f"s{i}") for i, c in enumerate(learnt)]
    told = rows.agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), *facts).first()
    outputs = len(labels) if len(labels) > 2 else 1
    spread = 4 * max((told["high"] or 0.0) - (told["low"] or 0.0), 1e-12) if task == "regression" else 1.0
    scale = 2.0 ** int(np.floor(51 - np.log2(max(told["n"], 1) * max(spread, 1.0))))
    starts = [Growth(i, s, outputs, task == "regression", scale, spread, [float(told[f"s{i}"] or 0) / max(told[f"n{i}"], 1)] if task == "regression" else [0.0] * outputs, done=not told[f"n{i}"] or len(labels) == 1) for i in range(len(conditions))]
    borders = borders_of(rows, own, s.bins)
    blocks = materialise(as_blocks(rows, own, borders, len(conditions)))
    groups = blocks.agg(F.sum("m")).first()[0] or 0
    made = (_grow_in_tasks if groups * len(columns) <= local_cells and told["n"] <= LOCAL_ROWS else _grow_by_levels)(blocks, starts) if groups else [(g, None) for g in starts]
    return [Ensemble(list(columns), borders, labels, g.base, g.trees, g.losses, {} if m is None else g.metrics(m)) for g, m in made]


def predicted(df: DataFrame, model: Ensemble, name: str = "prediction") -> DataFrame:
    """Adds the model's number, or the label of its likeliest class; null for rows with a null or NaN in a column."""
    borders, labels = model.borders, np.array(model.labels)

    @F.pandas_udf("double")
    def said(cells: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for d in cells:
            values = d.to_numpy(float)
            score = model.scores(np.stack([to_bins(v, b) for v, b in zip(values.T, borders, strict=True)]))
            if len(labels) > 2:
                out = labels[score.argmax(axis=1)]
            else:
                out = score[:, 0] if not len(labels) else labels[(score[:, 0] > 0).astype(int) * (len(labels) - 1)]
            yield pd.Series(out).where(~np.isnan(values).any(axis=1))

    return df.withColumn(name, said(F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(model.columns)])))
