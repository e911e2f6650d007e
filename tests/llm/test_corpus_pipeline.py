"""The pipeline against what its stages promise, stage by stage on its own input."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from serieslab.llm import mixing, secrets
from serieslab.llm.common import materialise
from tests.llm.test_text_operators import SPACE, best_windows, brute_classes


def brute_redaction(text):
    """The text with all spans replaced, overlapping ones by one mark."""
    if text is None:
        return None
    spans = sorted((m.start(), m.end()) for r in secrets.ALL_RULES for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for s, e in spans:
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def brute_mix(rows, got):
    """Whether the taken rows meet each source's target, from counts of words."""
    totals = Counter()
    for r in rows:
        totals[r["source"]] += len(SPACE.findall(r["text"] or ""))
    taken = Counter()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 < r["copies"] and r["size"] == len(SPACE.findall(r["text"]))
        taken[r["source"]] += r["taken"]
    largest = {s: max((len(SPACE.findall(r["text"] or "")) for r in rows if r["source"] == s), default=0) for s in totals}
    assert all(abs(taken[s] - t) <= max(0.02 * t, largest[s]) for s, t in mixing.target_shares(totals).items())


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, d))
        seen.append(docs.collect())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first, good, single, clean, redacted, mixed = seen
    assert {r["doc_id"] for r in good} < {r["doc_id"] for r in first}
    assert all(len(SPACE.findall(r["text"])) >= 50 for r in good)
    classes = brute_classes({r["doc_id"]: r["text"] for r in good})
    assert sorted(r["doc_id"] for r in single) == sorted({c for c, _ in classes.values()})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean}
    assert left < {r["doc_id"] for r in single}
    for r in single:
        if len(r["text"]) < (1500 if r["doc_id"] in left else 20_000):
            assert (r["doc_id"] in left) == (not best_windows(r["text"], items))
    before = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"]: r["text"] for r in redacted} == {k: brute_redaction(t) for k, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in redacted)
    brute_mix(redacted, mixed)
    assert sorted(map(str, mixed)) == sorted(map(str, pipeline.run(spark, d).collect()))


def text(name, n=60, more=""):
    return " ".join(f"{name}{i} word" for i in range(n // 2)) + more


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null keys, repeated rows, one key for two texts, columns with the names of results, secrets and a benchmark passage."""
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(1, text("a")), (7, text("a")), (7, text("b")), (None, text("a")), (8, text("c")), (8, text("c")), (9, text("d")), (9, text("e")), (None, text("f", more=" password=hunter22x")), (None, None), (3, ""), (4, "short")]
    rows += [(20, text("g") + " " + text("item", 40) + " " + text("h")), (21, text("k", 5000))] + [(100 + i, text(f"x{i}y")) for i in range(30)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, size string, copies long, h long, text_key string, h2 string"
    spark.createDataFrame([(k, t, "en", [None, "s", "t"][i % 3], None, "big", 5, 1, "k", None) for i, (k, t) in enumerate(rows)], kind).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, text("item", 40)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_run_on_odd_rows(spark, odd):
    got = pipeline.run(spark, odd).collect()
    want = [(1, text("a")), (7, text("b")), (8, text("c")), (9, text("d")), (9, text("e")), (None, text("f", more=" [SECRET]")), (21, text("k", 5000))] + [(100 + i, text(f"x{i}y")) for i in range(30)]
    assert {(r["doc_id"], r["text"]) for r in got} <= set(want) and len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    assert all(r["source"] in (None, "s", "t") and r["h"] == 1 and isinstance(r["size"], int) and r["taken"] == r["copies"] * r["size"] for r in got)
    for source in (None, "s", "t"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_mix_of_repeated_rows(spark):
    rows = [(5, text("a"), "en", "s", 1)] * 7 + [(None, text("b"), "en", "s", 1)] * 2 + [(i, text(f"c{i}"), "en", "t", 1) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = pipeline.mixed(spark, docs, "").collect()
    copies = mixing.copies_of(docs, h=F.xxhash64(*docs.columns)).collect()
    assert Counter({(r["doc_id"], r["text"]): r["copies"] for r in got}).total() == sum(r["copies"] for r in copies)
    assert len([r for r in got if r["doc_id"] == 5]) <= 1
    brute_mix([dict(zip(docs.columns, r, strict=True)) for r in rows], got)


def test_empty_documents(spark):
    import tempfile

    d = tempfile.mkdtemp(prefix="spark-")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.mode("overwrite").parquet(f"{d}/{t}.parquet")
    assert pipeline.run(spark, d).count() == 0
