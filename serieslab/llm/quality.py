"""Quality rules in DataFrame functions only: text statistics and a decision list learned from labelled ones.

Sequential covering: a rule for bad texts grows condition by condition, each the threshold with the largest information gain on
two thirds of the labelled rows; it is cut back to the prefix that does best on the last third; what it covers is set aside, and
the next rule is learned, until a rule is no longer precise enough there. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import WORD_SPACE, counted, materialise, words

SYMBOLS = tuple("#*$%&|<>")
#: Ratios that rules may test, as expressions over the statistics; zero for a text without words or lines.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "coalesce(try_divide(word_chars, n_words), 0d)",
    "symbol_ratio": "coalesce(try_divide(n_symbols, n_words), 0d)",
    "dup_line_ratio": "coalesce(try_divide(n_dup_lines, n_lines), 0d)",
    "repeat_ratio": "coalesce(try_divide(n_repeat_words, n_words), 0d)",
    "distinct_ratio": "coalesce(try_divide(n_distinct_words, n_words), 0d)",
    "upper_ratio": "coalesce(try_divide(n_upper, word_chars), 0d)",
    "mark_ratio": "coalesce(try_divide(n_marks, n_words), 0d)",
    "digit_ratio": "coalesce(try_divide(n_digits, word_chars), 0d)",
    "line_words": "coalesce(try_divide(n_words, n_lines), 0d)",
}


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and counts of every whole text (null: empty), all long.

    n_repeat_words counts the words inside three-word windows that occur at least twice in the text: windows are sorted by a 64-bit
    hash with their place, so that equal ones are neighbours, and the places found are merged. A kept column that has the name of a
    count is replaced."""
    own = [c for c in keep if c not in STATISTICS]
    base = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_sl_text"))
    split = base.withColumn("_sl_words", words(F.col("_sl_text"))).withColumn("_sl_lines", F.filter(F.split("_sl_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]"))))
    n = F.size("_sl_words")
    w = F.col("_sl_words")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at"))
    sorted_ = split.withColumn(
        "_sl_sorted",
        F.when(n < 3, F.array().cast("array<struct<h:bigint,at:int>>")).otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))),
    )
    s = F.col("_sl_sorted")
    same = lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
    places = sorted_.withColumn("_sl_places", F.sort_array(F.transform(F.filter(s, same), lambda x: x["at"])))
    covered = F.aggregate(
        "_sl_places",
        F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + 3).alias("stop"), (acc["n"] + p + 3 - F.greatest(acc["stop"], p)).alias("n")),
        lambda acc: acc["n"],
    )
    t = F.col("_sl_text")
    spaces = counted(t, WORD_SPACE)
    counts = {
        "n_words": n,
        "word_chars": F.length(t) - spaces,
        "n_symbols": counted(t, SYMBOLS),
        "n_dup_lines": F.size("_sl_lines") - F.size(F.array_distinct("_sl_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_sl_lines"),
        "n_distinct_words": F.size(F.array_distinct("_sl_words")),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
        "n_marks": counted(t, ("!", "?")),
        "n_digits": F.length(t) - F.length(F.regexp_replace(t, "[0-9]+", "")),
    }
    return places.select(*own, *[c.cast("long").alias(k) for k, c in counts.items()])


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


DecisionList = list[tuple[Condition, ...]]


def labelled(labels: DataFrame, label: str = "quality", key: str = "doc_id") -> DataFrame:
    """(doc_id, bad) of the keys whose labels agree; null keys and labels are left out."""
    return (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("doc_id"))
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        .where("lo = hi")
        .select("doc_id", (F.col("lo") == 0).alias("bad"))
    )


def learn_rules(
    stats: DataFrame,
    labels: DataFrame,
    most_rows: int = 200_000,
    most_rules: int = 8,
    most_conditions: int = 3,
    precision: float = 0.95,
    support: int = 5,
    bins: int = 32,
) -> DecisionList:
    """The decision list for bad texts. `stats`: doc_id and STATISTICS. At most about `most_rows` labelled rows are used, chosen by
    a hash of the key. A rule is kept if, on the third of rows held back, it covers `support` bad ones with this precision; so
    without labels, or with labels of one kind, the list is empty. Each condition costs one pass over the labelled rows, of which
    counts by feature, bin and label come back."""
    names = list(FEATURES)
    rows = stats.join(labelled(labels), "doc_id").select(F.xxhash64("doc_id").alias("h"), "bad", *[F.expr(FEATURES[f]).alias(f) for f in names])
    rows = materialise(rows)
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * most_rows / n))
    probs = [i / bins for i in range(1, bins)]
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(f, probs, 1000).alias(f) for f in names]).collect()
    if len(cuts) < 2:
        return []
    at = {f: sorted({float(x) for r in cuts for x in r[f]}) for f in names}
    binned = materialise(rows.select(F.array(*[_place(f, at[f]) for f in names]).alias("b"), "bad", (F.pmod("h", F.lit(3)) < 2).alias("grow")))
    index = {f: i for i, f in enumerate(names)}

    def met(c: Condition) -> Column:
        b = F.get("b", F.lit(index[c.feature]))
        j = at[c.feature].index(c.threshold)
        return b > j if c.above else b <= j

    found: DecisionList = []
    while len(found) < most_rules:
        left = binned
        for r in found:
            left = left.where(~_both([met(c) for c in r]))
        rule, held = [], []
        while len(rule) < most_conditions:
            own = left.where(_both([met(c) for c in rule])) if rule else left
            got = own.select(F.posexplode("b").alias("f", "bin"), "bad", "grow").groupBy("f", "bin", "bad", "grow").count().collect()
            best = _best(got, names, at)
            if best is None:
                break
            rule.append(best[1])
            held.append(best[2])
            if best[3] == 0:
                break
        if not rule:
            break
        score = [(p - n) / (p + n) if p + n else -1 for p, n in held]
        cut = score.index(max(score))
        p, n = held[cut]
        if p < support or p < precision * (p + n):
            break
        found.append(tuple(rule[: cut + 1]))
    return found


def _place(feature: str, thresholds: list[float]) -> Column:
    """How many of the thresholds lie below the value."""
    value = F.col(feature)
    return sum(((value > t).cast("int") for t in thresholds), F.lit(0))


def _both(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _best(got: list, names: list[str], at: dict[str, list[float]]):
    """(gain, condition, (bad, good) on the rows held back, good left on the growing rows) of the best threshold."""
    counts: dict = {}
    for r in got:
        counts[r["f"], r["bin"], r["grow"], r["bad"]] = r["count"]
    best = None
    for i, f in enumerate(names):
        size = len(at[f]) + 1
        cum = {}
        for grow in (True, False):
            for bad in (True, False):
                run, total = [], 0
                for b in range(size):
                    total += counts.get((i, b, grow, bad), 0)
                    run.append(total)
                cum[grow, bad] = run
        whole = {k: v[-1] for k, v in cum.items()}
        p0, n0 = whole[True, True], whole[True, False]
        if not p0 or not n0:
            return None
        for j in range(size - 1):
            for above in (True, False):
                side = {k: (whole[k] - v[j]) if above else v[j] for k, v in cum.items()}
                p, n = side[True, True], side[True, False]
                if not p:
                    continue
                gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Condition(f, above, at[f][j]), (side[False, True], side[False, False]), n)
    return best


def first_rule(rules: DecisionList) -> Column:
    """The first rule that a row of statistics meets, as text, else null: one ordered conditional expression."""
    out = None
    for r in rules:
        met, said = _both([c.column() for c in r]), F.lit(" and ".join(map(str, r)))
        out = F.when(met, said) if out is None else out.when(met, said)
    return F.lit(None).cast("string") if out is None else out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """The statistics with base_failed, rule (the first that rejects, else null) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": first_rule(rules)}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
