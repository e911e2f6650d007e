"""Source divergence audit: how far the sources of a language differ in their terms, and by which terms.

Terms are counted by Arrow's compute functions inside each task (ascii_lower, split_pattern_regex, dictionary_encode, hash group_by), which
leaves a row for each language, source and term; Spark adds these partial counts up. A language keeps the terms that enough of its
documents have. Shares are whole numbers, computed by long division, so that results are exact and do not depend on the order of sums.

Distances between sources are sums over terms. The terms of a language are dealt to shards, as many as its sources and terms need; a task
lays one shard out as a matrix of sources by terms and sums absolute differences of its rows, and Spark adds the shards up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.llm.common import materialise, sized

#: Fixed value: what stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text counted at a time; rows of partial counts that a task holds before it hands them on; cells of
#: a shard's matrix, if its sources are not more than its terms.
SLICE, HELD, CELLS = 16 << 20, 400_000, 16_000
#: Sources whose distances to all others a task computes, and such distances; most cells of a shard's matrix.
BLOCK, PAIRS, MOST = 200, 1_000_000, 2_000_000
KEYS = ["lang", "source", "term"]


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def counted_terms(part: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some rows: occurrences of the term, and rows that have it. Every (lang, source) also has a row of the
    term '' with zeros, so that groups without terms are known."""
    lists = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), pattern=BETWEEN)
    row, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(term, "")
    row, term = row.filter(real), term.filter(real).dictionary_encode()
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    by_row = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    at = by_row["row"].combine_chunks()
    coded = pa.table({"lang": lang.indices.take(at), "source": source.indices.take(at), "term": by_row["term"], "n": by_row["count_all"]})
    sums = coded.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ([], "count_all")])
    spelled = {c: d.dictionary.take(sums[c].combine_chunks()) for c, d in (("lang", lang), ("source", source), ("term", term))}
    found = pa.table(spelled | {"n": sums["n_sum"], "docs": sums["count_all"]})
    groups = pa.table({c: part.column(c) for c in ("lang", "source")}).group_by(["lang", "source"]).aggregate([]).select(["lang", "source"])
    zeros = pa.array(np.zeros(len(groups), np.int64))
    return pa.concat_tables([found, groups.append_column("term", pa.array([""] * len(groups), pa.string())).append_column("n", zeros).append_column("docs", zeros)])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's rows. They are merged as they come in, and handed on whenever merging leaves more than HELD rows."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        out = pa.concat_tables(held).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select([*KEYS, "n_sum", "docs_sum"]).rename_columns([*KEYS, "n", "docs"])

    for batch in batches:
        for part in slices(batch):
            held.append(counted_terms(part))
            if sum(map(len, held)) > HELD:
                held = [merged()]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().combine_chunks().to_batches()
    if held:
        yield from merged().combine_chunks().to_batches()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), nulls counting as ''; the term '' with zeros stands for the group itself."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts = rows.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    return counts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, smoothing: int) -> Column:
    """1 + floor(10^9 (count + smoothing) / (total + smoothing terms)), three decimals at a time, so that nothing overflows; null without terms."""
    below = F.nullif(total + F.lit(smoothing) * terms, F.lit(0).cast("long"))
    rest, out = count + F.lit(smoothing), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, below), rest % below
    return out + 1


def distances(cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums over terms of the absolute differences of the sources' shares. cells: lang, shard, block, source,
    term, p; a row without term gives the share of terms that the source lacks, and `own`, whether the source is of the block."""

    def shard_sums(g: pd.DataFrame) -> pd.DataFrame:
        marks = g[g["term"].isna()].sort_values("source")
        sources, own = marks["source"].to_numpy(object), np.flatnonzero(marks["own"].to_numpy(bool))
        real = g[g["term"].notna()]
        code, terms = pd.factorize(real["term"])
        shares = np.repeat(marks["p"].fillna(0).to_numpy(np.int64)[:, None], len(terms), axis=1)
        shares[pd.Index(sources).get_indexer(real["source"]), code] = real["p"].to_numpy(np.int64)
        values = np.array([np.abs(shares - shares[i]).sum(axis=1) for i in own], np.int64).reshape(len(own), len(sources))
        other = own[:, None] != np.arange(len(sources))[None, :]
        at, to = np.nonzero(other)
        return pd.DataFrame({"lang": g["lang"].iloc[0], "source": sources[own[at]], "item": sources[to], "value": values[other]})

    sums = cells.groupBy("lang", "shard", "block").applyInPandas(shard_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 30, smoothing: int = 5, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks all other sources of the language by their distance, part `term` the
    `top` terms that are commoner in the source than in its language, by the difference of shares.

    Null texts, languages and sources are ''; a source without kept terms has distances like one that lacks all of them, and no terms; a
    language without kept terms has distances of 0. Ties go by code point. Repeated rows count as often as they are there; an empty table
    gives no rows; other columns are not read, whatever their names. Nothing depends on the partitioning."""
    counts = materialise(term_counts(docs, text, lang, source))
    terms = materialise(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where((F.col("docs") >= least) & (F.col("term") != "")).drop("docs"))
    kept = materialise(counts.where("n > 0").drop("docs").join(terms, ["lang", "term"]))
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    groups = counts.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    many = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = materialise(groups.join(many, "lang").join(by_lang, "lang", "left").select("lang", "source", "sources", zero("total"), zero("terms"), zero("lang_total")))
    joined = kept.join(sized(groups), ["lang", "source"])
    shares = materialise(
        joined.select(*KEYS, share(F.col("n"), F.col("total"), F.col("terms"), smoothing).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("terms"), smoothing).alias("q"), "sources", "terms")
    )

    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)

    of_shard = F.greatest(F.lit(1.0), F.least(F.greatest(F.col("sources"), CELLS / F.col("sources")), MOST / F.col("sources")))
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / of_shard))
    width = F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.floor(F.lit(PAIRS) / F.col("sources"))))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    place = Window.partitionBy("lang").orderBy("source")
    marks = groups.withColumn("at", F.row_number().over(place) - 1).withColumn("shard", upto(shards)).withColumn("block", upto(F.ceil(F.col("sources") / width)))
    absent = share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), smoothing)
    marks = marks.select("lang", "shard", "block", "source", F.lit(None).cast("string").alias("term"), absent.alias("p"), (F.floor(F.col("at") / width) == F.col("block")).alias("own"))
    cells = shares.withColumn("shard", F.pmod(F.xxhash64("term"), shards)).withColumn("block", upto(F.ceil(F.col("sources") / width)))
    cells = cells.select("lang", "shard", "block", "source", "term", "p", F.lit(None).cast("boolean").alias("own"))
    apart = distances(cells.unionByName(marks)).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(w))
    return apart.unionByName(typical)
