"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query. The index has one posting (trigram, text key) for every trigram of
those queries that a text holds; postings are intersected per text and rule, and only the candidates are matched against the
rule's expression. A rule without mandatory trigrams (long hexadecimal runs) is matched against every text.

The text key is a hash of the text itself, so repeated rows share postings and a collision can only add a candidate, which the
match then refutes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import BROADCAST_ROWS, materialise, sized
from serieslab.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A match counts if the given group has at least `least` characters. `probe`, if given, is a cheaper test that every
    counting match passes."""

    kind: str
    pattern: str
    group: int
    least: int
    probe: str = ""


#: The base rules, in the order in which spans with the same start are listed, then further ones.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\x20\x09-\x0D-]*?-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)
ALL_RULES = BASE_RULES + MORE_RULES

#: Trigrams to one long of a text's mask; matches that are gathered at a time.
BITS, BLOCK = 60, 128
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def indexed_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that any rule's query names: all that the index needs to hold for these rules."""
    return sorted({g for r in rules for c in trigram_query(r.pattern) for s in c for g in s})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, text: str = "text") -> DataFrame:
    """(trigram int, text_key long): the inverted index, a row for each indexed trigram that a text holds, letters folded.
    Null and empty texts have no postings."""
    low = F.lower(text)
    held = F.filter(
        F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(indexed_trigrams(rules))]), F.isnotnull
    )
    return docs.select(F.explode(held).alias("trigram"), F.xxhash64(text).alias("text_key"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """(text_key, rules array<int>): postings intersected per text; rules are those whose query the text meets."""
    names = indexed_trigrams(rules)
    at = {g: i for i, g in enumerate(names)}
    longs = range((len(names) + BITS - 1) // BITS)
    masks = index.groupBy("text_key").agg(
        *[
            F.bit_or(F.when(F.floor(F.col("trigram") / BITS) == k, F.expr(f"shiftleft(1L, trigram % {BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"m{k}")
            for k in longs
        ]
    )

    def whole(grams: frozenset[str]) -> Column:
        need = [sum(1 << at[g] % BITS for g in grams if at[g] // BITS == k) for k in longs]
        return _all([F.col(f"m{k}").bitwiseAND(F.lit(n).cast("long")) == F.lit(n).cast("long") for k, n in enumerate(need) if n])

    met = []
    for i, r in enumerate(rules):
        if query := trigram_query(r.pattern):
            met.append(F.when(_all([_any([whole(s) for s in c]) for c in query]), F.lit(i)))
    found = F.filter(F.array(*met), F.isnotnull)
    return masks.select("text_key", found.alias("rules")).where(F.size("rules") > 0)


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches that count: what lies between the matches gives their places."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    own = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.transform(
        F.arrays_zip(between.alias("b"), whole.alias("w"), own.alias("o")),
        lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["w"]).alias("w"), F.length(x["o"]).alias("o")),
    )
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["b"]
        last = first + F.coalesce(x["w"], F.lit(0))
        one = F.struct(first.alias("start"), F.lit(kind).alias("kind"), last.alias("stop"))
        out = F.when(x["o"] >= rule.least, F.array_append(F.coalesce(acc["out"], none), one)).otherwise(acc["out"])
        return F.struct(last.alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))
    blocks = F.transform(in_blocks(lengths), lambda b: F.aggregate(b, start, step))
    moved = F.transform(
        with_running(blocks, lambda b: b["at"], lambda so_far, n: so_far + n),
        lambda z: F.transform(F.coalesce(z["x"]["out"], none), lambda s: F.struct((s["start"] + z["before"]).alias("start"), s["kind"].alias("kind"), (s["stop"] + z["before"]).alias("stop"))),
    )
    found = F.flatten(moved)
    return F.when(F.rlike(text, F.lit(rule.probe)), found).otherwise(none) if rule.probe else found


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with the value computed once, where a lambda would compute it again for each element."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def in_blocks(values: Column) -> Column:
    """An array as an array of blocks of BLOCK elements: what is gathered by appending is copied inside a block only."""

    def cut(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))

    return bound(values, cut)


def with_running(values: Column, number: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """An array of structs of the elements, x, and of what the numbers of those before make, joined from 0 on: before."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], number(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return bound(values, lambda v: F.arrays_zip(v.alias("x"), F.aggregate(v, start, step, lambda acc: acc["out"]).alias("before")))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, text: str = "text", out: str = "secret_spans", most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows with one more column: array of (start, kind, stop) by start, then by the rule's place; code points, stop
    exclusive. Null texts have no spans. A column of that name is replaced.

    Candidates' keys are broadcast while they are at most `most`; beyond that the join on the text key shuffles."""
    index = postings(docs, rules, text)
    found = sized(materialise(candidates(index, rules)).select(F.col("text_key").alias("_sl_key"), F.col("rules").alias("_sl_rules")), most)
    body = docs.drop(out)
    rows = body.select(F.struct(*[body[c] for c in body.columns]).alias("_sl_row"), F.col(text).alias("_sl_text"), F.xxhash64(text).alias("_sl_key")).join(found, "_sl_key", "left")
    none = F.array().cast(SPAN)
    whole = F.coalesce(F.col("_sl_text"), F.lit(""))
    parts = []
    for i, r in enumerate(rules):
        spans = rule_spans(whole, r, i)
        parts.append(spans if not trigram_query(r.pattern) else F.when(F.array_contains("_sl_rules", i), spans).otherwise(none))
    return rows.select("_sl_row.*", F.array_sort(F.concat(*parts)).alias(out))


def spelled(spans: Column, rules: tuple[Rule, ...] = ALL_RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: its key and `secret_spans`. Only these two columns are read, so others can have any name."""
    return with_spans(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), rules)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows, all columns kept, with every span in the text replaced by a mark; overlapping spans become one mark. Null and empty texts stay
    as they are. Columns may have any name but `_sl_spans`. Time grows with the text and its matches, however many these are."""
    rows = with_spans(docs, rules, text, "_sl_spans")
    body = F.col(text)
    # blocks of spans, each with the end of all spans before it; inside a block the same for each span
    stops = lambda xs: F.array_max(F.transform(xs, lambda s: s["stop"]))
    blocks = with_running(in_blocks(F.col("_sl_spans")), stops, F.greatest)

    def cleaned(z: Column) -> Column:
        spans = with_running(z["x"], lambda s: s["stop"], F.greatest)
        fresh = F.filter(F.transform(spans, lambda y: F.struct(y["x"]["start"].alias("start"), F.greatest(y["before"], z["before"]).alias("before"))), lambda y: y["start"] >= y["before"])
        part = F.substr(body, z["before"] + 1, F.greatest(F.element_at(z["x"], -1)["start"] - z["before"], F.lit(0)))  # what the block's gaps are cut from
        return bound(part, lambda t: F.array_join(F.transform(fresh, lambda y: F.concat(F.substr(t, y["before"] - z["before"] + 1, y["start"] - y["before"]), F.lit(mark))), ""))

    clean = F.concat(F.array_join(F.transform(blocks, cleaned), ""), F.substr(body, stops(F.col("_sl_spans")) + 1, F.length(body)))
    return rows.withColumn(text, F.when(F.size("_sl_spans") > 0, clean).otherwise(body)).drop("_sl_spans")
