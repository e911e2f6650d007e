"""Importance resampling: draw the documents whose words look most like those of a target text collection.

Words come from an untrained pre-tokenisation (a regular expression split over text with A-Z lower-cased). Runs of consecutive words are
windows of offset pairs over the words laid out with one space between them; their CRC-32 picks a bucket. Corpus and target each give one
histogram of buckets, every bucket a whole-numbered gain, and a document the floored mean gain of its runs. Keys give each document a
Gumbel number, so that the highest sums of weight and number are a draw without replacement in proportion to the weights.

Texts are split once: what is written down is, for each document, its distinct buckets with counts. Histograms are partial sums by task;
only `buckets` numbers reach the driver. The draw numbers documents along ranges of their scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.core import with_row_index
from serieslab.llm.common import materialise

#: Fixed value: words of lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Characters of a text that are split at a time; pieces end between words.
PIECE = 1 << 20


@cache
def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def words_of(text: str | None) -> Iterator[str]:
    """The words of a text, in order. Null, empty and wordless texts have none; very long ones are split piece by piece."""
    from tokenizers import PreTokenizedString

    low, at = (text or "").encode().lower().decode(), 0
    while at < len(low):
        cut = BETWEEN.search(low, at + PIECE) if len(low) - at > PIECE else None
        end = cut.start() if cut else len(low)
        piece = low[at:end]
        found = PreTokenizedString(piece)
        splitter().pre_tokenize(found)
        for _, (start, stop), _ in found.get_splits("original", "char"):
            yield piece[start:stop]
        at = end


def run_hashes(words: list[str], lengths: tuple[int, int]) -> list[int]:
    """CRC-32 of every run of so many words, joined by one space: slices of the laid out words between pairs of offsets."""
    laid = [w.encode() for w in words]
    line = b" ".join(laid)
    ends = (np.cumsum(np.fromiter(map(len, laid), np.int64, len(laid)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [crc32(line[s:e]) for k in range(lengths[0], lengths[1] + 1) for s, e in zip(starts, ends[k - 1 :], strict=False)]


def bucketed(docs: DataFrame, text: str = "text", keep: tuple[Column, ...] = (), lengths: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """The kept columns, n_words, n_features (long), and the document's distinct buckets with their counts, as arrays."""
    rows = docs.select(*keep, F.col(text).alias("_sl_text"))
    kept = rows.drop("_sl_text")
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "n_words long, n_features long, buckets array<int>, counts array<int>"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, at, found, counts = [], [], [0], [], []
            for text in batch.column("_sl_text"):
                words = list(words_of(text.as_py()))
                runs = np.array(run_hashes(words, lengths), np.int64) % buckets
                own, n = np.unique(runs, return_counts=True)
                n_words.append(len(words))
                n_features.append(len(runs))
                at.append(at[-1] + len(own))
                found.append(own.astype(np.int32))
                counts.append(n.astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (found, counts)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists], names=[*batch.schema.names[:-1], "n_words", "n_features", "buckets", "counts"])

    return rows.mapInArrow(split, kind)


def histogram(rows: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): a task adds up its rows, then the tasks' sums are added up by bucket."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            own, n = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            np.add.at(total, own, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return rows.select("buckets", "counts").mapInArrow(partial, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares that target and corpus have in the bucket), for every bucket, from their histograms."""
    s, t = ({r["bucket"]: r["n"] for r in h.collect()} for h in (corpus, target))  # `buckets` rows at most
    all_s, all_t = sum(s.values()), sum(t.values())
    share = lambda b: float(t.get(b, 0) + 1) * (all_s + buckets) / (float(s.get(b, 0) + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(buckets)], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Replaces the arrays of `bucketed` by weight, the floored mean gain of the document's runs (none: 0)."""
    kept = rows.drop("buckets", "counts").schema.fields
    names = [f.name for f in kept]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "weight long"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            own, n = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[own] * n)])
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            features = batch.column("n_features").to_numpy()
            weight = np.where(features > 0, (sums[at[1:]] - sums[at[:-1]]) // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(weight, pa.int64())], names=[*names, "weight"])

    return rows.mapInArrow(weigh, kind)


def gumbel(key: Column, seed: str) -> Column:
    """floor(1000 times a standard Gumbel number) from the first 32 bits of SHA-256 of `seed:key`; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_scores(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", lengths: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: str = "2024", keep: tuple[str, ...] = ()
) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_features, weight, score, and the columns of `keep` in a struct `row`.

    Null texts are empty; documents without a run have weight 0; an empty corpus gives no rows, an empty target shares of zero. Repeated
    rows score alike. Columns that are not named are not read, whatever they are called. Equal inputs give equal scores in any partitioning."""
    kept = (F.col(key).alias("doc_id"), *([F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []))
    rows = materialise(bucketed(docs, text, kept, lengths, buckets))
    gain = gains(histogram(rows, buckets), histogram(bucketed(target, target_text, (), lengths, buckets), buckets), buckets)
    out = weighted(rows, gain)
    return out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def drawn(scored: DataFrame, percent: int = 10, least: int = 20) -> DataFrame:
    """Adds rank, from 1 for the highest score, to floor(percent * N / 100) of the N documents with at least `least` words; null for all
    others. Ties go to the smaller doc_id, null first, then to more runs. Documents are numbered along ranges of their scores."""
    fit = F.col("n_words") >= least
    ordered = materialise(scored.withColumns({"_sl_out": (~fit).cast("int"), "_sl_score": -F.col("score"), "_sl_runs": -F.col("n_features")}))
    n = ordered.where("_sl_out = 0").count() * percent // 100
    placed = with_row_index(ordered, ["_sl_out"], ["_sl_score", "doc_id", "_sl_runs"], "_sl_idx")
    rank = F.when((F.col("_sl_out") == 0) & (F.col("_sl_idx") < n), F.col("_sl_idx") + 1)
    return placed.withColumn("rank", rank.cast("long")).drop("_sl_out", "_sl_score", "_sl_runs", "_sl_idx")


def importance_draw(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text", **more) -> DataFrame:
    """The drawn rows of docs, with their own columns and `draw`, a struct of rank, weight and score. Other arguments, and odd rows, as in
    `importance_scores`; a column `draw` of docs is replaced."""
    scored = importance_scores(docs, target, key, text, target_text, keep=tuple(docs.columns), **more)
    chosen = drawn(scored, percent, least).where("rank is not null")
    return chosen.select("row.*", F.struct("rank", "weight", "score").alias("_sl_draw")).drop("draw").withColumnRenamed("_sl_draw", "draw")
