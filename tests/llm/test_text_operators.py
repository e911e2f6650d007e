"""Text operators against SQL, brute force and planted cases; nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from serieslab.llm import chat, contamination, jaccard, language, lattice, mixing, quality, queries, secrets, trigrams, urls
from tests.against_sql import same

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, rate double, key string"


def docs(spark, texts, **columns):
    rows = [(i, t, "en", f"s{i % 3}", None, i, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


EDGE = [None, "", " \n\t", "a", "password = abcdef1", "x " * 30_000, "same text here now and then again", "same text here now and then again", "\U0001f600 token: zzzzzzzz \U0001f600"]


@pytest.fixture(scope="module")
def edge(spark):
    df = docs(spark, EDGE)
    null_key = spark.createDataFrame([(None, "no key at all here", None, None, None, None, None, None)], SCHEMA)
    return df.unionByName(null_key).unionByName(df.where("doc_id = 6"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op1_secrets", "op6_chat", "op9_urls"])
def test_same_rows_as_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


# secrets
def test_trigram_queries():
    assert trigrams.trigram_query("[0-9a-f]+") == ()
    assert trigrams.trigram_query("AKIA[A-Z0-9]+") == ((frozenset({"aki", "kia"}),),)
    (clause,) = trigrams.trigram_query("(?:abc|bcde)x*")
    assert set(clause) == {frozenset({"abc"}), frozenset({"bcd", "cde"})}


def test_secret_spans(spark, edge, none):
    texts = ['my PassWord="hunter22", token=short', "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "é" * 5 + " " + "0f" * 12, "secret = token: abcdefgh", "api_key:abcdef apikey=ABCDEF1"]
    got = {r["doc_id"]: r["s"] for r in secrets.scan_secrets(docs(spark, texts)).select("doc_id", secrets.spelled(F.col("secret_spans")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = []
        for k, r in enumerate(secrets.BASE_RULES):
            want += [(m.start(), k, f"{r.kind}:{m.start()}:{m.end()}") for m in re.finditer(r.pattern, t) if len(m[r.group]) >= r.least]
        assert got[i] == ",".join(s for *_, s in sorted(want))
    rows = secrets.scan_secrets(edge).collect()
    assert len(rows) == edge.count() and sum(len(r["secret_spans"]) for r in rows) == 2
    assert secrets.scan_secrets(none).count() == 0


def test_texts_with_very_many_matches(spark):
    import time

    n = 100_000
    many = "token=abcdef " * n
    df = spark.createDataFrame([(1, many, "k"), (2, "é token=abcdef " * 300 + "end", "k")], "doc_id long, text string, _sl_key string")
    began = time.time()
    got = {r["doc_id"]: r["s"] for r in secrets.scan_secrets(df).select("doc_id", secrets.spelled(F.col("secret_spans")).alias("s")).collect()}
    clean = {r["doc_id"]: r for r in secrets.redact_secrets(df).collect()}
    assert time.time() - began < 60
    assert got[1] == ",".join(f"assign:{13 * i}:{13 * i + 12}" for i in range(n)) and got[2] == ",".join(f"assign:{15 * i + 2}:{15 * i + 14}" for i in range(300))
    assert clean[1]["text"] == "[SECRET] " * n and clean[2]["text"] == "é [SECRET] " * 300 + "end" and clean[1]["_sl_key"] == "k"


def test_large_candidate_sets_are_joined_by_shuffle(spark, edge):
    a, b = (secrets.with_spans(edge, most=m).select("doc_id", "secret_spans").collect() for m in (0, 1000))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_whole_private_keys_are_redacted(spark):
    body = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\nMIIEow/+ab==\nQx9\n-----END RSA PRIVATE KEY-----"
    texts = [f"before {body} after {body}", "only -----BEGIN PRIVATE KEY----- here's no end", f"{body}\n{body}"]
    got = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs(spark, texts)).collect()}
    assert got == {0: "before [SECRET] after [SECRET]", 1: "only [SECRET] here's no end", 2: "[SECRET]\n[SECRET]"}


def test_clashing_columns_are_kept(spark):
    df = docs(spark, ["password = abcdef1", None]).withColumn("rules", F.lit(1)).withColumn("trigram", F.lit("t")).withColumn("spans", F.lit("s"))
    out = secrets.redact_secrets(df)
    assert out.columns == df.columns and {r["text"] for r in out.collect()} == {"[SECRET]", None}


def test_redaction(spark, edge):
    got = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(edge).collect()}
    assert got[4] == "[SECRET]" and got[8] == "\U0001f600 [SECRET] \U0001f600" and got[0] is None and got[5] == EDGE[5]
    assert secrets.redact_secrets(edge).columns == edge.columns


# quality
def test_statistics(spark, sf_dir, edge, none):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    texts = sorted((r["text"] or "") for r in df.collect())
    got = quality.text_statistics(df.withColumn("n_words", F.lit(-1)), ("doc_id", "text")).collect()
    assert len(got) == len(texts)
    for r in got:
        t = r["text"] or ""
        w = SPACE.findall(t)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
    assert quality.text_statistics(none).count() == 0


def test_rules_are_learned_and_ordered(spark):
    rows = [(i, 100 + i % 50, 500, (i % 10 == 0) * (20 + i % 7), 0, (i % 10 == 1) * 90) + (5, 80, 1, 0, 0) for i in range(600)]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in quality.STATISTICS))
    labels = spark.createDataFrame([(i, int(i % 10 > 1), 0) for i in range(600)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn_rules(stats, labels)
    assert {r[0].feature for r in rules} == {"symbol_ratio", "repeat_ratio"}
    wrong = quality.judged(stats, rules).where("kept <> (doc_id % 10 > 1)").where("not base_failed").count()
    assert wrong == 0
    assert quality.learn_rules(stats, labels.where("quality = 1")) == []
    assert quality.judged(stats, []).where("rule is not null").count() == 0


@pytest.fixture(scope="module")
def wordless(spark):
    """200 labelled texts of 60 words, every second one bad with many symbols; null, empty and blank ones, labelled and not."""
    texts = [" ".join(f"word{i}x{k}" + "#" * (i % 2) for k in range(60)) for i in range(200)] + [None, "", " \n\t"] * 2
    labels = [(i, 1 - i % 2, 0) for i in range(200)] + [(i, 1, 0) for i in range(200, 203)]
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_texts_without_words_are_judged(wordless):
    df, labels = wordless
    stats = quality.text_statistics(df)
    assert stats.where("n_words = 0").select(*[F.expr(e) for e in quality.FEATURES.values()]).distinct().collect() == [(0.0,) * len(quality.FEATURES)]
    rules = quality.learn_rules(stats, labels)
    assert any("ratio" in c.feature for r in rules for c in r)
    got = {r["doc_id"]: r["kept"] for r in quality.judged(stats, rules).collect()}
    assert got == {i: i < 200 and i % 2 == 0 for i in range(206)}


def test_pipeline_stage_without_words(spark, wordless, tmp_path):
    import corpus_pipeline

    df, labels = wordless
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality(spark, df, str(tmp_path)).collect()) == list(range(0, 200, 2))


# similarity join
def brute_classes(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().split()) else set() for i, t in texts.items()}
    links, root = Counter(), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in texts}


def test_similarity_classes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_classes(df).collect()}
    assert got == brute_classes({r["doc_id"]: r["text"] for r in df.collect()})


def test_hot_families_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "EXACT_BLOCK", 6)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(40):
        w = list(base)
        w[(k * 13) % 80] = f"edit{k}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 10 + [f"other {k} " + " ".join(f"z{k}_{i}" for i in range(30)) for k in range(10)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similarity_classes(docs(spark, texts)).collect()}
    assert got == brute_classes(dict(enumerate(texts)))


def test_query_against_all_pairs(spark, sf_dir):
    from serieslab.llm.q_jaccard import op3_jaccard

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op3_jaccard(spark, sf_dir).collect()} == brute_classes(texts)


def test_one_of_each_class(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    near = a + " more"
    rows = [(1, a), (7, a), (7, b), (None, a), (8, c), (8, c), (9, d), (9, d), (9, e), (5, near), (None, "x y z"), (None, "x y z"), (3, None), (3, None), (4, " "), (None, "")]
    df = spark.createDataFrame([(k, t, str(i % 2), i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, text_key string, n long").repartition(3)
    out = jaccard.one_of_each_class(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (7, b), (8, c), (9, d), (9, e), (None, "x y z"), (3, None), (3, None), (4, " "), (None, "")], key=str)
    assert sorted(map(str, jaccard.one_of_each_class(df.repartition(5)).collect())) == sorted(map(str, out.collect()))
    assert jaccard.one_of_each_class(df.limit(0)).count() == 0


def test_similarity_edge_cases(spark, edge, none):
    rows = jaccard.similarity_classes(edge).collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["class_id"], r["n_links"]))
    assert by[0] == [(0, 0)] and by[6] == [(6, 2), (6, 2)] and by[7] == [(6, 2)]
    assert jaccard.similarity_classes(none).count() == 0


def test_posterior_bounds():
    least = jaccard.least_matches(0.8, 1e-8)
    assert list(least) == [16, 32, 48, 64] and all(m < 0.8 * n for n, m in least.items())


# language
def test_held_out_accuracy(spark):
    from serieslab.llm.q_language import op4_language

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in op4_language(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    for lengths in (range(300), range(300, 10**9)):
        out = [r for r in rows if got[r["doc_id"]]["held_out"] and len(r["text"] or "") in lengths and r["lang"]]
        assert sum(r["lang"] == got[r["doc_id"]]["lang_pred"] for r in out) >= (0.85 if lengths.start == 0 else 0.97) * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_dictionary_sample_takes_whole_texts(spark):
    df = spark.createDataFrame([(i, f"wort{i % 7} und der", "de") for i in range(50)] + [(99, "solo " * 5000, "es"), (7, "andere", "de"), (None, "x", "fr")], "doc_id long, text string, lang string")
    made = language.learn_dictionaries(df, most_bytes=400, usual=30)
    assert set(made) == {"de", "es"} and made["es"].split() == [b"solo"] * 5000 and len(made["de"]) <= 400
    assert made == language.learn_dictionaries(df.repartition(5), most_bytes=400, usual=30)


def test_prediction_is_the_shortest_encoding(spark):
    import zstandard

    made = {"a": b"the house and the garden of the old man " * 20, "b": b"das haus und der garten vom alten mann " * 20}
    texts = ["the house of the man", "der garten und das haus", "the garden " * 900, "das haus, 12 und der garten " * 900]
    rows = {r["doc_id"]: r for r in language.classify(docs(spark, texts), made).collect()}
    for i, t in enumerate(texts):
        data, sizes = " ".join(re.findall(r"[^\W\d_]+", t.lower())).encode(), {}
        for n, content in made.items():
            z = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[n] = sum(len(z.compress(data[k : k + language.BLOCK])) for k in range(0, len(data), language.BLOCK))
        low, high = sorted(sizes.values())
        assert rows[i]["lang_pred"] == min(sizes, key=sizes.get) == "ab"[i % 2]
        assert rows[i]["score"] == pytest.approx(1 - 2 ** (-(1 - low / high) / 0.03)) and rows[i]["accepted"] == (rows[i]["score"] >= 0.5)


def test_language_edge_cases(spark, edge, none):
    made = {"a": b"the and of " * 50, "b": b"der die das " * 50}
    got = {r["doc_id"]: r["lang_pred"] for r in language.classify(edge, made).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[5] in made
    assert {r["lang_pred"] for r in language.classify(edge, {}).collect()} == {"und"}
    assert language.classify(none, made).count() == 0 and language.learn_dictionaries(none) == {}


# mixing
def test_targets():
    got = mixing.target_shares({"b": 100, "a": 10, None: 50})
    assert got["a"] == pytest.approx(160 / 6) and got["b"] == pytest.approx(320 / 6) and got[None] == pytest.approx(80)
    got = mixing.target_shares({"a": 100, "b": 1, "c": 1})
    assert got == {"a": pytest.approx(96), "b": 3, "c": 3}
    assert mixing.target_shares({}) == {}


def test_mix_meets_targets(spark, edge, none):
    from serieslab.llm.q_mixing import op5_mixing

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op5_mixing(spark, "/root/testdata/sf0.01").collect()
    sizes = {r["doc_id"]: (len(SPACE.findall(r["text"] or "")), r["source"]) for r in df.collect()}
    totals = Counter()
    for n, s in sizes.values():
        totals[s] += n
    goal, taken = mixing.target_shares(totals), Counter()
    assert len(rows) == len(sizes)
    for r in rows:
        n, s = sizes[r["doc_id"]]
        assert (r["size"], r["source_size"], r["target"]) == (n, totals[s], pytest.approx(goal[s])) and r["taken"] == r["copies"] * n <= 3 * n
        taken[s] += r["taken"]
    assert all(abs(taken[s] / t - 1) < 0.02 for s, t in goal.items())
    first, again = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert mixing.mix(edge).count() == edge.count() and mixing.mix(none).count() == 0


def test_repeated_rows_are_mixed_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    text = " ".join(["w"] * 10)
    rows = [(2**60 + 1, text, "en", "a", None, 0, 0.5, "x")] * 50 + [(i, " ".join(["v"] * (5 + i % 7)), "en", "b", None, i, 0.5, "x") for i in range(200)] + [(None, text, "en", None, None, 0, 0.5, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.mix(df).collect()
    same_rows = [r for r in got if r["doc_id"] == 2**60 + 1]
    assert len(got) == 251 and len(same_rows) == 50 and max(r["copies"] for r in same_rows) - min(r["copies"] for r in same_rows) <= 1
    assert abs(sum(r["taken"] for r in same_rows) - same_rows[0]["target"]) <= 10
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(2)).collect()))


def test_rates_solve_the_dual(spark):
    """Three sources, two classes, a soft margin: the multipliers make the gradient vanish, by plain Newton steps on the same sums."""
    import numpy as np

    cells = {("a", 1): 400, ("a", 2): 100, ("b", 1): 50, ("b", 2): 350, ("c", 2): 100}
    df = spark.createDataFrame([(s, c, n) for (s, c), n in cells.items()], "source string, size_class int, size long")
    goal = {"source": {"a": 300.0, "b": 500.0, "c": 300.0}, "size_class": {1: 700.0, 2: 300.0}}
    dual = mixing.multipliers(df, goal, 3.0, 0.5)
    rate = {k: min(3.0, math.exp(dual["source"][k[0]] + dual["size_class"][k[1]])) for k in cells}
    for s, t in goal["source"].items():
        assert sum(n * rate[k] for k, n in cells.items() if k[0] == s) == pytest.approx(t, rel=1e-6)
    for c, t in goal["size_class"].items():
        assert sum(n * rate[k] for k, n in cells.items() if k[1] == c) + 0.5 * t * dual["size_class"][c] == pytest.approx(t, rel=1e-6)
    assert len({round(rate["a", c], 6) for c in (1, 2)}) == 2 and np.isfinite(list(rate.values())).all()


def test_two_margins(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (20 + i % 9)), "en" if i % 3 else "de", "st"[i % 2], None, None, None, None) for i in range(600)], SCHEMA)
    total = sum(20 + i % 9 for i in range(600))
    goal = {"source": {"s": 0.6 * total, "t": 0.4 * total}, "lang": {"en": 0.5 * total, "de": 0.5 * total}}
    dual = mixing.multipliers(mixing.sizes(df, ("source", "lang")), goal)
    rate = lambda i: math.exp(dual["source"]["st"[i % 2]] + dual["lang"]["en" if i % 3 else "de"])
    assert sum((20 + i % 9) * rate(i) for i in range(600) if i % 3) == pytest.approx(0.5 * total, rel=1e-6)
    assert sum((20 + i % 9) * rate(i) for i in range(0, 600, 2)) == pytest.approx(0.6 * total, rel=1e-6)


# chat
def test_preferences(spark):
    kind = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    u, a, b = ("user", "hi <|end|>"), ("assistant", "yes"), ("assistant", "né")
    rows = spark.createDataFrame([(1, [u, a], [u, b], "x"), (2, [u], [u], None), (3, None, [u, a], None), (4, [a], [b], None), (5, [u, a], [u], None)], kind)
    got = {r["pair_id"]: r for r in chat.format_preferences(rows).collect()}
    assert got[1]["n_common"] == 1 and got[1]["prompt"] == "<|user|>\nhi <end>\n<|end|>\n"
    for side in ("chosen", "rejected"):
        (s,) = got[1][f"{side}_spans"]
        assert got[1][side][s["start"] : s["stop"]] == ("yes" if side == "chosen" else "né") + "\n<|end|>\n"
    assert got[2]["n_common"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["prompt"] == "" and got[3]["chosen"] == "" and got[5]["rejected"] == "" and got[5]["chosen"]
    assert got[4]["n_common"] == 0
    assert chat.format_preferences(rows.limit(0)).count() == 0


def test_turns(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "z"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conversation"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.turns_of(rows).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("", "")]}


# language model
def small_pieces():
    p = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.2, "▁a": 0.15, "▁ab": 0.05, "ba": 0.1}
    return lattice.Pieces({k: math.log(v) for k, v in p.items()}, [math.log(1e-4)] * 256), p


def all_segmentations(text, p):
    if not text:
        return 1.0
    return sum(p[text[:k]] * all_segmentations(text[k:], p) for k in range(1, len(text) + 1) if text[:k] in p)


def test_lattice_sums_over_all_segmentations():
    pieces, p = small_pieces()
    for w in ("a", "ab", "abba", "bababab"):
        assert math.exp(pieces.log_probability(w)) == pytest.approx(all_segmentations("▁" + w, p))
    assert math.exp(pieces.log_probability("é")) == pytest.approx(0.1 * 1e-8)
    counts: dict = {}
    pieces.expected("abab", 2.0, counts, __import__("numpy").zeros(256))
    assert sum(len(k) * v for k, v in counts.items()) == pytest.approx(2 * 5)
    assert pieces.log_probability("ab" * 50_000) < -1000


@pytest.mark.parametrize("word", ["\U0001f600" * n for n in (10, 13, 30, 39, 60)] + ["中" * 17, "ab" * 20 + "\U0001f600" * 40, "\U0001f600" * 100 + "ab" * 1000, "ba" * 500 + "中" * 300 + "ab" * 500])
def test_every_word_has_its_say(word):
    import numpy as np

    pieces, p = small_pieces()
    pieces.byte_logs = [math.log(1e-4 / 256)] * 256
    counts, byte_counts = {}, np.zeros(256)
    pieces.expected(word, 3.0, counts, byte_counts)
    rare = [c for c in word if c not in p]
    assert byte_counts.sum() == pytest.approx(3 * sum(len(c.encode()) for c in rare))
    assert sum(len(k) * v for k, v in counts.items()) == pytest.approx(3 * (1 + len(word) - len(rare)))


def test_expected_uses_by_logs_are_the_same():
    import numpy as np

    pieces, _ = small_pieces()
    for w in ("a", "abba", "babéab", "ab" * 20):
        made = {}, np.zeros(256)
        logs = {}, np.zeros(256)
        pieces.expected(w, 2.0, *made)
        pieces._expected_by_logs("▁" + w, pieces.edges("▁" + w), 2.0, *logs)
        assert made[0] == pytest.approx(logs[0]) and np.allclose(made[1], logs[1])


def test_scores(spark, edge, none, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 3)
    pieces, _ = small_pieces()
    df = docs(spark, ["a b A", "ab ab", None, "zz a", "zz a"])
    out = F.col("doc_id") >= 3
    rows = {r["doc_id"]: r for r in lattice.score_texts(df, out, pieces).collect()}
    train = Counter(w for t in ("a b A", "ab ab", "") for w in [*t.lower().split(), "</s>"])
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(["a b A", "ab ab", "", "zz a", "zz a"]):
        tokens = [*t.lower().split(), "</s>"]
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[x] > 0 for x in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens))
        assert r["score"] < 0 and r["held_out"] == (i >= 3)
    assert lattice.score_texts(edge, F.lit(False), pieces).count() == edge.count()
    assert lattice.score_texts(edge, F.lit(True), pieces).where("n_known > 0").count() == 0
    assert lattice.score_texts(none, F.lit(False), pieces).count() == 0


# urls
def naive_verdict(rules, url, default="allow"):
    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [x for x in rules if host and x.host and (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
    best = max(fit, key=lambda x: (len(x.name), len(x.host), x.verdict == "block"), default=None)
    return host, path, best and best.name, best.verdict if best else default


def test_url_rules(spark):
    rule = urls.UrlRule
    rules = [rule("block", "com", "/en/"), rule("allow", "example.com", "/en/7"), rule("block", "b.example.com", "/"), rule("block", "example.com", "/en/7"), rule("allow", "example.com", ""), rule("block", "", "/"), rule("block", "net", "/a"), rule("allow", "net", "/a")]
    hosts = ["example.com", "a.example.com", "B.example.com", "example-x.com", "xexample.com", "com", "com.", "", "a..com", "b.example.com:80", "x.net"]
    paths = ["", "/", "/en/", "/en/7x?q=/en/", "#/en/", "/de", "/abc"]
    all_urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "example.com/en/"]
    df = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(all_urls + all_urls)], "page_id long, url string, host string, key string").repartition(3)
    for parts in (1, 5, 40):
        got = urls.judge_urls(df, rules, partitions=parts).collect()
        assert len(got) == 2 * len(all_urls)
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == naive_verdict(rules, r["url"])
    assert urls.judge_urls(df.limit(0), rules).count() == 0 and urls.judge_urls(df, []).where("rule is not null").count() == 0
    kept = urls.filter_urls(df, rules)
    assert kept.columns == df.columns and kept.count() == 2 * sum(naive_verdict(rules, u)[3] == "allow" for u in all_urls)


def test_many_url_rules_as_a_table(spark):
    import random

    rng = random.Random(2)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rules = [urls.UrlRule(rng.choice(["block", "allow"]), name(), rng.choice(["", "/", "/x", "/x/y", "/xy"])) for _ in range(300)]
    all_urls = [f"https://{name()}{rng.choice(['', '/', '/x', '/x/y/z', '/xyz', '/q'])}" for _ in range(1500)] + ["https://a.a/x"] * 700
    df = spark.createDataFrame(list(enumerate(all_urls)), "page_id long, url string").repartition(4)
    got = urls.judge_urls(df, urls.rules_table(spark, rules).repartition(3), partitions=9).collect()
    assert len(got) == len(all_urls)
    for r in got:
        assert (r["rule"], r["verdict"]) == naive_verdict(rules, r["url"])[2:]


# contamination
def naive_similarity(a, b, size=5):
    """Weighted Jaccard similarity of two lists of words, counted anew."""

    def shingles(w):
        k = min(size, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    x, y = shingles(a), shingles(b)
    weigh = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
    both = weigh(x & y)
    return both / (weigh(x) + weigh(y) - both)


def best_windows(text, items, threshold=0.8):
    """{item_id: best similarity} over all windows."""
    w, out = contamination.folded_words(text or ""), {}
    for key, item in items:
        v = contamination.folded_words(item or "")
        if not w or not v or not set(w) & set(v):
            continue
        n = min(len(v), len(w))
        top = max(naive_similarity(w[p : p + n], v) for p in range(len(w) - n + 1))
        if top >= threshold - 1e-9:
            out[key] = top
    return out


def test_windows_against_all(spark, edge, none):
    item = " ".join(f"word{i}" for i in range(40))
    words = item.split()
    edited = words[:20] + ["other"] + words[21:]
    texts = [f"before {item} after", "Before, " + item.upper().replace(" ", ", ") + "!", " ".join(edited), " ".join(words[:39]), " ".join(words[:20]), "nothing here", None, f"{item} x {item}", "a tiny item"]
    rows = [(1, item), (2, None), (3, "tiny item"), (4, ""), (5, item), (None, item)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    for most in (1, 100):
        got: dict = {}
        for r in contamination.contaminated_windows(docs(spark, texts), items, most_items=most).collect():
            got.setdefault(r["doc_id"], {})[r["item_id"]] = pytest.approx(r["similarity"])
        assert got == {i: b for i, t in enumerate(texts) if (b := best_windows(t, [r for r in rows if r[0]]))}
    assert got[8] == {3: 1} and got[0] == {1: 1, 5: 1}
    assert contamination.contaminated_windows(edge, items).count() == 0 and contamination.contaminated_windows(none, items).count() == 0
    left = contamination.decontaminated(docs(spark, texts), items, most_items=1)
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(len(texts)) if i not in got] and left.columns == docs(spark, texts).columns
    assert contamination.decontaminated(docs(spark, texts), items.limit(0)).count() == len(texts)


def test_recall_of_the_query(spark, sf_dir):
    from serieslab.llm.q_contamination import op10_contamination

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got: dict = {}
    for r in op10_contamination(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = r["similarity"]
    texts = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r["text"] or "") < (20_000 if r["doc_id"] in got else 1500)]
    got = {r["doc_id"]: got[r["doc_id"]] for r in texts if r["doc_id"] in got}
    want = {r["doc_id"]: b for r in texts if (b := best_windows(r["text"], items))}
    pairs = [(d, k) for d, b in want.items() for k in b]
    assert len(pairs) >= 3 and sum(k in got.get(d, {}) for d, k in pairs) >= 0.9 * len(pairs)
    assert all(k in want[d] and s <= want[d][k] + 1e-9 for d, g in got.items() for k, s in g.items())


def test_edited_items_are_found():
    import random

    rng, v = random.Random(5), [f"w{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(20, 90)))) for k in range(60)]
    index, pairs, found = contamination.ItemIndex(items, 5), 0, 0
    for key, item in items * 3:
        w = item.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(v)
        text = " ".join([*(rng.choice(v) for _ in range(rng.randint(0, 50))), *w, *(rng.choice(v) for _ in range(rng.randint(0, 50)))])
        best = best_windows(text, [(key, item)])
        got = {h[0]: h[4] for h in index.hits(text, contamination.RADIUS, 0.8)}
        pairs += len(best)
        found += sum(k in got and got[k] <= s + 1e-9 for k, s in best.items())
    assert pairs > 80 and found >= 0.97 * pairs


def test_long_texts_take_linear_time(monkeypatch):
    import random
    import time

    rng = random.Random(0)
    words = [f"w{rng.randrange(300)}" for _ in range(160_000)]
    index, took = contamination.ItemIndex([(1, " ".join(words[5000:7000])), (2, " ".join(words[5000:5100] * 30))], 5), {}
    for n in (20_000, 160_000):
        start = time.perf_counter()
        assert index.hits(" ".join(words[:n]), 17, 0.8)[0][:3] == (1, 5000, 2000)
        took[n] = time.perf_counter() - start
    assert took[160_000] < 30 * max(took[20_000], 0.02)
    monkeypatch.setattr(contamination, "CHUNK", 100)
    monkeypatch.setattr(contamination, "PAIRS", 7)
    assert index.hits(" ".join(words[:20_000]), 17, 0.8)[0][:3] == (1, 5000, 2000)


def test_index_finds_all_within_radius():
    import numpy as np

    index = contamination.ItemIndex([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(5)], 5).near[30]
    for k in range(200):
        bits = int(hashlib.sha256(str(k).encode()).hexdigest(), 16)
        flips = {(bits >> (6 * j)) % 64 for j in range(contamination.RADIUS)}
        g = int(index.prints[k % 5]) ^ sum(1 << b for b in flips)
        place, item, distance = index.within(np.array([g], np.uint64), contamination.RADIUS)
        assert (k % 5, len(flips)) in set(zip(item.tolist(), distance.tolist(), strict=True)) and len(place) == len(set(item.tolist()))
