"""Benchmark decontamination: windows of texts that are close to a benchmark item.

A window has as many words as the item. Windows and items get SimHash fingerprints of their words, weighted by length. Items' fingerprints
are in a multi-index: one of BLOCKS parts of two fingerprints within the radius differs in at most two bits, and each part's table names
the items for all such values, so no fingerprint within the radius is missed. Candidates are verified by the exact weighted similarity
of their word shingles, whose sums slide along the text with the window. A window that holds no shingle of any item of its size has
similarity zero, so only stretches of text around such shingles are fingerprinted.

Texts are read in chunks that overlap by the longest item, so memory does not grow with the text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import materialise

NOT_WORD = re.compile(r"[\W_]+")
#: Bits of the parts of a fingerprint; with a radius under 3 * len(BLOCKS) some part differs in at most 2 bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 17
#: Words of a text that are fingerprinted at a time, and candidate pairs that are compared at a time.
CHUNK, PAIRS = 1 << 16, 1 << 20
HIT = "array<struct<item_id:bigint,start:int,n_words:int,distance:int,similarity:double>>"


def folded_words(text: str) -> list[str]:
    return NOT_WORD.sub(" ", text.lower()).split()


@lru_cache(1 << 17)
def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out ^ (out >> np.uint64(32))


def lengths_of_runs(weight: np.ndarray, size: int) -> np.ndarray:
    """Characters of each run of `size` words, spaces apart."""
    total = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
    return total[size:] - total[:-size] if len(total) > size else np.zeros(0, np.int64)


def fingerprints(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` words at the given places, in ascending order; windows are taken in chunks of bounded span."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = int(np.searchsorted(starts, low + CHUNK))
        high = int(starts[stop - 1]) + size
        sign = ((h[low:high, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1
        total = np.zeros((high - low + 1, 64), np.int64)
        np.cumsum(sign * weight[low:high, None], axis=0, out=total[1:])
        own = starts[at:stop] - low
        bits = (total[own + size] - total[own]) > 0
        out[at:stop] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        at = stop
    return out


def parts(values: np.ndarray) -> Iterator[np.ndarray]:
    for b in BLOCKS:
        yield (values & np.uint64((1 << b) - 1)).astype(np.int64)
        values = values >> np.uint64(b)


class Hashes:
    """A set of hashes: a bitmap of their low bits refutes most others, the rest are looked up."""

    def __init__(self, values: np.ndarray):
        self.sorted = np.unique(values)
        self.mask = np.uint64((1 << max(12, (32 * len(self.sorted)).bit_length())) - 1)
        self.bitmap = np.zeros(int(self.mask) + 1, bool)
        self.bitmap[self.sorted & self.mask] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        """Where values are in the set, ascending."""
        at = np.flatnonzero(self.bitmap[values & self.mask])
        found = np.searchsorted(self.sorted, values[at])
        found[found == len(self.sorted)] = 0
        return at[self.sorted[found] == values[at]]


class MultiIndex:
    """Fingerprints by the values of their parts and all values within two bits of these."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for bits, values in zip(BLOCKS, parts(prints), strict=True):
            flips = np.array([0, *(1 << i for i in range(bits)), *((1 << i) | (1 << j) for i, j in combinations(range(bits), 2))], np.int64)
            near = (values[:, None] ^ flips).ravel()
            order = np.argsort(near, kind="stable")
            heads = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << bits))])
            self.tables.append((heads, (order // len(flips)).astype(np.int32)))

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, distance) of all pairs within the radius, each once."""
        found: list[np.ndarray] = []
        n = len(self.prints)
        for (heads, items), values in zip(self.tables, parts(prints), strict=True):
            sizes = heads[values + 1] - heads[values]
            ends = np.cumsum(sizes)
            at = 0
            while at < len(prints):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
                own = sizes[at:stop]
                place = np.repeat(np.arange(at, stop), own)
                offset = np.arange(len(place)) - np.repeat(np.cumsum(own) - own, own)
                item = items[heads[values[place]] + offset]
                close = np.bitwise_count(prints[place] ^ self.prints[item]) <= radius
                found.append(place[close] * n + item[close])
                at = stop
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        place, item = pairs // n, pairs % n
        return place, item, np.bitwise_count(prints[place] ^ self.prints[item]).astype(int)


class Item:
    """A benchmark item: its shingles with their counts and weights."""

    def __init__(self, key: int, words: list[str], size: int):
        self.key, self.n, self.size = key, len(words), min(size, len(words))
        h, weight = hashes(words), np.array([len(w) for w in words], np.int64)
        self.words, self.weight = h, weight
        shingle, weigh = runs(h, self.size), lengths_of_runs(weight, self.size)
        self.total = int(weigh.sum())
        self.shingles, first, self.counts = np.unique(shingle, return_index=True, return_counts=True)
        self.weights = weigh[first]

    def similarities(self, shingle: np.ndarray, weigh: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Weighted Jaccard similarity of shingle multisets of the windows at ascending starts; a shingle weighs its characters. shingle and
        weigh: of the whole text; width: shingles to a window. One pass over the text's shingles that the item has."""
        low, high = int(starts[0]), int(starts[-1]) + width
        at = np.searchsorted(self.shingles, shingle[low:high])
        at[at == len(self.shingles)] = 0
        mine = np.flatnonzero(self.shingles[at] == shingle[low:high])
        which, where = at[mine].tolist(), (mine + low).tolist()
        total = np.concatenate([[0], np.cumsum(weigh[low:high])])
        counts, weights = self.counts.tolist(), self.weights.tolist()
        seen, both, head, tail = [0] * len(counts), 0, 0, 0
        out = np.zeros(len(starts))
        for k, s in enumerate(starts.tolist()):
            while head < len(where) and where[head] < s + width:
                g = which[head]
                both += weights[g] if seen[g] < counts[g] else 0
                seen[g] += 1
                head += 1
            while tail < head and where[tail] < s:
                g = which[tail]
                seen[g] -= 1
                both -= weights[g] if seen[g] < counts[g] else 0
                tail += 1
            own = int(total[s + width - low] - total[s - low])
            out[k] = both / (own + self.total - both)
        return out


class ItemIndex:
    """Shingles and fingerprints of benchmark items, by their number of words."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.items = [Item(i, w, size) for i, t in items if (w := folded_words(t or ""))]
        by_length: dict[int, list[int]] = {}
        for k, item in enumerate(self.items):
            by_length.setdefault(item.n, []).append(k)
        self.by_length = {n: (min(size, n), np.array(ks), Hashes(np.concatenate([self.items[k].shingles for k in ks]))) for n, ks in by_length.items()}
        self.sizes = {s: Hashes(np.concatenate([g.sorted for t, _, g in self.by_length.values() if t == s])) for s in {s for s, _, _ in self.by_length.values()}}
        self.near = {n: MultiIndex(np.array([self.print_of(self.items[k]) for k in ks], np.uint64)) for n, (_, ks, _) in self.by_length.items()}

    @staticmethod
    def print_of(item: Item) -> int:
        return int(fingerprints(item.words, item.weight, np.zeros(1, np.int64), item.n)[0])

    def hits(self, text: str | None, radius: int, threshold: float) -> list[tuple]:
        """(item_id, start, n_words, distance, similarity) of the best window for each item that has one."""
        words = folded_words(text) if text else []
        if not words or not self.items:
            return []
        h = hashes(words)
        known = {s: (r, at) for s, g in self.sizes.items() if len(at := g.places(r := runs(h, s)))}
        if not known:
            return []
        weight = np.array([len(w) for w in words], np.int64)
        best: dict[int, tuple] = {}
        for n, (s, ks, own) in self.by_length.items():
            if s not in known:
                continue
            shingle, at = known[s]
            places = at[own.places(shingle[at])]
            if not len(places):
                continue
            width, last = min(n, len(words)), max(0, len(words) - n)
            edge = np.zeros(last + 2, np.int64)  # windows that hold such a shingle, as merged intervals of starts
            np.add.at(edge, np.clip(places - n + s, 0, last), 1)
            np.add.at(edge, np.minimum(places, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]))
            place, item, distance = self.near[n].within(fingerprints(h, weight, starts, width), radius)
            weigh = lengths_of_runs(weight, s)
            order = np.argsort(item, kind="stable")
            place, item, distance = place[order], item[order], distance[order]
            for a, b in zip(np.flatnonzero(np.diff(item, prepend=-1)), np.flatnonzero(np.diff(item, append=-1)) + 1, strict=True):
                k = int(ks[item[a]])
                got = self.items[k].similarities(shingle, weigh, starts[place[a:b]], width - s + 1)
                top = int(got.argmax())
                if got[top] >= threshold - 1e-9:
                    best[k] = (self.items[k].key, int(starts[place[a + top]]), width, int(distance[a + top]), float(got[top]))
        return [best[k] for k in sorted(best)]


_INDEX: dict[str, ItemIndex] = {}


def index_of(name: str, block: list[tuple[int, str]], size: int) -> ItemIndex:
    """The index of a block, built once in a Python worker; an earlier block's makes way."""
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = ItemIndex(block, size)
    return _INDEX[name]


def item_blocks(items: DataFrame, most: int, most_bytes: int, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `most` items and `most_bytes` characters, of which the driver holds one at a time: a benchmark is a
    stated set of queries, and each block scans the texts once."""
    rows = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // most), -(-size // most_bytes))
    if blocks > 1:
        rows = materialise(rows.withColumn("b", F.pmod(F.xxhash64("k", "t"), F.lit(blocks))))
    for i in range(blocks):
        own = rows.where(F.col("b") == i) if blocks > 1 else rows
        yield [(r["k"], r["t"]) for r in own.orderBy("k", "t").collect()]


def contamination(body: Column, block: list[tuple[int, str]], size: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> Column:
    """Array of hits of a whole text against one block of items; empty for null and empty texts."""
    if radius >= 3 * len(BLOCKS):
        raise ValueError(f"the index covers radii under {3 * len(BLOCKS)}")
    name = uuid.uuid4().hex

    @F.pandas_udf(HIT)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = index_of(name, block, size)
        names = ("item_id", "start", "n_words", "distance", "similarity")
        for batch in texts:
            yield pd.Series([[dict(zip(names, h, strict=True)) for h in index.hits(t, radius, threshold)] for t in batch], dtype=object)

    return find(body)


def contaminated_windows(
    docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, most_items: int = 20_000, most_bytes: int = 32 << 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """A row (doc_id, item_id, start, n_words, distance, similarity) for each row of docs and each item to which a window of the text has
    at least the threshold's similarity: the best window, the first of equal ones. start counts the text's folded words. A text shorter
    than an item is one window. Items with equal texts are each reported; null items and texts give nothing, nor do items without key;
    repeated rows repeat; other columns are not read, whatever their names."""
    out = None
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
    for block in item_blocks(items, most_items, most_bytes, item_key, item_text):
        found = rows.select("doc_id", F.explode(contamination(F.col("body"), block, size, threshold)).alias("hit")).select("doc_id", "hit.*")
        out = found if out is None else materialise(out).union(materialise(found))
    return out


def decontaminated(
    docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, most_items: int = 20_000, most_bytes: int = 32 << 20, text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows, all columns kept, of which no window is close to an item."""
    first = True
    for block in item_blocks(items, most_items, most_bytes, item_key, item_text):
        docs = (docs if first else materialise(docs)).where(F.size(contamination(F.col(text), block, size, threshold)) == 0)
        first = False
    return docs
