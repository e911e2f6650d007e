"""Importance resampling, WARC archives and the divergence audit against SQL, brute force and planted cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from serieslab.llm import divergence, importance, q_divergence, q_importance, q_warc, queries, warc
from tests.against_sql import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, weight double, row string, rank string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, None, 0.5, "x", "y") for r in rows], SCHEMA).repartition(n)


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t!", "en", "a"), (4, "Aé\x00ÀB é" * 3, "en", "b"), (5, "wörd " * 40_000, "en", None),
    (6, "one two three " * 9, "en", "b"), (6, "one two three " * 9, "en", "b"), (None, "one two four " * 9, None, "b"), (8, "x" * 100_000 + " END", "", ""), (9, "İI ſs K 12 a1b2", "de", "c"),
]


@pytest.mark.parametrize("name", ["op11_importance", "op12_warc", "op13_divergence"])
def test_same_rows_as_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def odd_tables(spark, folder, docs, benchmark=(), pages=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string, key string, original string, record_type int").repartition(3).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a/3\r\nX: y", "<p>same</p>"), (4, "u", None), (5, "u", ""), (5, "u", ""), (None, "n", "<p>same</p>"), (None, "n", "one"),
    (6, "http://é", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3), (7, "u", "é😀\x00\n" * 50_000), (8, "u", "é😀\x00\n" * 50_000), (9, "u", "\r\n\r\n"),
]


@pytest.mark.parametrize("case", ["odd", "empty"])
def test_odd_rows_as_sql(spark, tmp_path, case):
    full = case == "odd"
    where = odd_tables(spark, tmp_path, frame(spark, ODD if full else []), [(1, "one two x"), (2, None)] if full else (), [(*p, "k", "o", 3) for p in PAGES] if full else ())
    for m, name in ((q_importance, "op11_importance"), (q_warc, "op12_warc"), (q_divergence, "op13_divergence")):
        same(spark, where, m.QUERIES[name], m.ORACLE_SQL[name])
        assert full or m.QUERIES[name](spark, where).count() == 0


# importance resampling
def test_words_and_runs():
    assert list(importance.words_of("Ab-cÉd\x00É 1\x7fZ")) == ["ab", "cÉd", "É", "1", "z"]
    assert list(importance.words_of(None)) == [] == importance.run_hashes([], (1, 3))
    words = ["a", "é", "cc"]
    assert importance.run_hashes(words, (1, 2)) == [zlib.crc32(x.encode()) for x in ("a", "é", "cc", "a é", "é cc")]
    long = ("abc " * 9 + "défg;") * 60_000
    assert list(importance.words_of(long)) == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", long)


def test_importance_by_brute_force(spark):
    texts = [" ".join(f"w{(i * j) % 17}" for j in range(i % 40)) for i in range(200)]
    docs, target = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), frame(spark, [(0, "w1 w2 w3 w1 w2", "en", "s")])
    runs = lambda t: [" ".join(w[i : i + k]) for w in [t.split()] for k in (1, 2) for i in range(len(w) - k + 1)]
    bucket = lambda t: [zlib.crc32(r.encode()) % 50 for r in runs(t)]
    s, t = Counter(b for x in texts for b in bucket(x)), Counter(bucket("w1 w2 w3 w1 w2"))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)}
    h = lambda i: int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
    want = {}
    for i, x in enumerate(texts):
        own = [gain[b] for b in bucket(x)]
        weight = math.floor(sum(own) / len(own)) if own else 0
        want[i] = (len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h(i) + 0.5) / 2**32))))
    more = {"lengths": (1, 2), "buckets": 50, "seed": "7"}
    got = importance.importance_scores(docs, target, **more)
    assert {r["doc_id"]: (r["n_features"], r["weight"], r["score"]) for r in got.collect()} == want
    fit = [i for i, x in enumerate(texts) if len(x.split()) >= 20]
    order = sorted(fit, key=lambda i: (-want[i][2], i))[: len(fit) * 25 // 100]
    taken = importance.importance_draw(docs, target, 25, 20, **more).collect()
    assert {r["doc_id"]: r["draw"]["rank"] for r in taken} == {i: k + 1 for k, i in enumerate(order)}
    assert all(r["text"] == texts[r["doc_id"]] and r["rank"] == "y" for r in taken)


def test_importance_draws_what_resembles_the_target(spark):
    like, other = "alpha beta gamma " * 10, "delta epsilon zeta " * 10
    docs = frame(spark, [(i, like if i % 5 == 0 else other, "en", "s") for i in range(400)])
    taken = importance.importance_draw(docs, frame(spark, [(0, like, "en", "s")]), 10).collect()
    assert len(taken) == 40 and sum(r["text"] == like for r in taken) >= 36


# archives
def test_archives_are_read_by_their_lengths(spark, tmp_path):
    def rec(kind, rid, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": rid, "Content-Length": str(len(block)), **more}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    web = {"Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "http://a"}
    sha = base64.b32encode(hashlib.sha1(b"\xff\x00body").digest()).decode()
    records = [
        rec("warcinfo", "<i>", b"software: x\r\n"), rec("response", "<a>", http + b"\xff\x00body", **web), rec("response", "<b>", http + b"\xff\x00body", **web),
        rec("revisit", "<c>", b"", **{"WARC-Refers-To": "<a>", "WARC-Payload-Digest": f"sha1:{sha}"}), rec("revisit", "<d>", b"", **{"WARC-Refers-To": "<gone>", "WARC-Payload-Digest": "sha1:GONE"}),
    ]
    os.mkdir(tmp_path / "in")
    (tmp_path / "in/one.warc").write_bytes(b"".join(records[:2]))
    (tmp_path / "in/two.warc.gz").write_bytes(b"".join(map(gzip.compress, records[2:])))
    got = warc.read_archives(spark, str(tmp_path / "in"), payload=True).collect()
    assert {r["record_id"]: r["payload"] for r in got} == {"<i>": b"software: x\r\n", "<a>": b"\xff\x00body", "<b>": b"\xff\x00body", "<c>": b"", "<d>": b""}
    warc.deduplicate_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    out = warc.read_archives(spark, str(tmp_path / "out"), payload=True).collect()
    kinds = Counter(r["record_type"] for r in out)
    assert kinds == {"warcinfo": 1, "response": 1, "revisit": 3} and len({r["record_id"] for r in out}) == 5
    (held,) = [r for r in out if r["record_type"] == "response"]
    assert bytes(held["payload"]) == b"\xff\x00body" and bytes(held["http"]) == b"HTTP/1.1 200 OK\r\nServer: x" and held["declared_digest"] == f"sha1:{sha}"
    assert Counter(r["refers_to"] for r in out if r["record_type"] == "revisit") == {held["record_id"]: 2, "<gone>": 1}
    seen = warc.followed(warc.read_archives(spark, str(tmp_path / "out"))).where("record_type = 'revisit'").collect()
    assert sorted((r["payload_bytes"] or -1) for r in seen) == [-1, 6, 6]


def test_cut_archives_fail(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    (tmp_path / "in/a.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark, str(tmp_path / "in")).collect()


def test_least_bytes_and_shuffled_revisits(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * (i % 3)) for i in range(30)], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "sized", lambda df: df)
    got = {int(r["key"]): r for r in warc.archived_pages(pages, least=2).collect()}
    assert len(got) == 30 and sorted(k for k, r in got.items() if r["record_type"] == "revisit") == list(range(2, 29, 3))
    assert all(r["original_key"] == "29" and r["payload_bytes"] == 2 for r in got.values() if r["record_type"] == "revisit")


def test_digest(spark):
    for x in (b"", b"a", b"\xff" * 99):
        assert spark.createDataFrame([(x,)], "b binary").select(warc.digest(F.col("b"))).first()[0] == base64.b32encode(hashlib.sha1(x).digest()).decode()


# divergence
def audited(rows, least, smoothing=5, top=50):
    terms = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))) for _, t, la, s in rows]
    docs, by, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for la, s, ts in terms:
        docs[la].update(set(ts))
        by[la, s].update(ts)
        by[la, None].update(ts)
        groups[la].add(s)
    out = set()
    for la, sources in groups.items():
        kept = [t for t in docs[la] if docs[la][t] >= least]

        def share(key, kept=kept):
            n = sum(by[key][t] for t in kept)
            return {t: 1 + 10**9 * (by[key][t] + smoothing) // (n + smoothing * len(kept)) for t in kept}

        p, q = {s: share((la, s)) for s in sources}, share((la, None))
        for s in sources:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out |= {(la, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pair)}
            term = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if by[la, s][t] and p[s][t] > q[t])[:top]
            out |= {(la, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(term)}
    return out


def test_divergence_by_brute_force(spark, monkeypatch):
    rows = [(i, " ".join(f"w{chr(97 + (i * j + j) % 23)}é" for j in range(i % 30)), ["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None) for i in range(300)]
    rows += [(900, "rare", "fr", "s1"), (901, None, "fr", "s2"), *ODD]
    for least, sizes in ((5, {}), (1, {"CELLS": 60, "MOST": 60, "BLOCK": 2, "PAIRS": 10, "SLICE": 64, "HELD": 40})):
        for k, v in sizes.items():
            monkeypatch.setattr(divergence, k, v)
        got = divergence.audit_sources(frame(spark, rows), least=least, top=4).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == audited(rows, least, top=4)


def test_partial_counts_without_tasks():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a b A", "", "b"] * 50, "lang": ["x"] * 150, "source": ["s", "t", "s"] * 50})
    rows = pa.Table.from_batches(list(divergence.partial_counts(iter([batch, batch.slice(0, 0)])))).to_pylist()
    assert {(r["source"], r["term"]): (r["n"], r["docs"]) for r in rows} == {("s", "a"): (100, 50), ("s", "b"): (100, 100), ("s", ""): (0, 0), ("t", ""): (0, 0)}
