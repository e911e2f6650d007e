"""Scoring texts with a language model over subword lattices, and with smoothed word counts.

The pieces are those of an existing vocabulary. Its scores rank pieces; they give each a first probability, which expected counts over
all segmentations of the training words then correct. A word's probability is the sum over all its segmentations, by a forward
recursion in logarithms; a text's probability is the product over its words, with a chance to end after each.

Words are counted in one pass and scored once per distinct word. Scores come back to texts by a dictionary of the most frequent words,
whose number is fixed, and for all other words by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import materialise

#: The token that ends a text; no word holds a space.
END = b" "
#: The most frequent words, which are scored without a join; distinct words that a task counts before it hands them on.
FREQUENT, HELD = 65_536, 200_000
SPACE = "▁"
#: Words less probable than this have their expected uses counted in logarithms; for the others plain products stay within range.
LEAST = 1e-200
LOG10 = math.log(10)


class Pieces:
    """Log probabilities of vocabulary pieces; characters that no piece spells are spelled by byte pieces."""

    def __init__(self, logs: dict[str, float], byte_logs: list[float]):
        self.logs, self.byte_logs = logs, byte_logs

    @classmethod
    def load(cls, path: str, offset: float = 20.0) -> Pieces:
        """From a sentencepiece model. Its scores fall with the rank of a piece; probabilities fall as 1 / (rank + offset)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        spelled = sorted((i for i in ids if not model.is_byte(i)), key=lambda i: (-model.get_score(i), i))
        weights = {model.id_to_piece(i): 1 / (rank + offset) for rank, i in enumerate(spelled)}
        total = sum(weights.values())
        byte = math.log(1e-4 / 256)
        return cls({p: math.log(w / total * (1 - 1e-4)) for p, w in weights.items()}, [byte] * 256)

    @cached_property
    def prefixes(self) -> dict[str, float | None]:
        """Every beginning of a piece, with the log probability of those that are pieces; built where it is used."""
        out: dict[str, float | None] = {p[:k]: None for p in self.logs for k in range(1, len(p))}
        out.update(self.logs)
        return out

    def __getstate__(self) -> dict:
        return {"logs": self.logs, "byte_logs": self.byte_logs}

    def edges(self, text: str) -> list[list[tuple[int, float, str]]]:
        """For each place in the text, the (start, log probability, piece) of the pieces that end there."""
        prefixes, none = self.prefixes, 0.0  # no piece has the probability one
        n = len(text)
        out: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                lp = prefixes.get(piece, none)
                if lp is None:
                    continue
                if lp == none:
                    break
                out[j - 1].append((i, lp, piece))
        for j, c in enumerate(text):
            if c not in self.logs:
                out[j].append((j, sum(self.byte_logs[b] for b in c.encode("utf-8", "surrogatepass")), ""))
        return out

    def forward(self, edges: list) -> list[float]:
        alpha = [0.0]
        for own in edges:
            terms = [alpha[i] + lp for i, lp, _ in own]
            top = max(terms)
            alpha.append(top + math.log(sum([math.exp(t - top) for t in terms])) if len(terms) > 1 else top)
        return alpha

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations of a word."""
        return self.forward(self.edges(SPACE + word))[-1]

    def expected(self, word: str, weight: float, counts: dict[str, float], byte_counts: np.ndarray) -> None:
        """Adds the expected number of uses of each piece in a word that occurs `weight` times."""
        text = SPACE + word
        edges = self.edges(text)
        linear = [[(i, math.exp(lp), piece) for i, lp, piece in own] for own in edges]
        alpha = [1.0]
        for own in linear:
            total = 0.0
            for i, p, _ in own:
                total += alpha[i] * p
            alpha.append(total)
        if alpha[-1] < LEAST:
            return self._expected_by_logs(text, edges, weight, counts, byte_counts)
        beta = [0.0] * len(linear) + [weight / alpha[-1]]
        for j in range(len(linear), 0, -1):
            b = beta[j]
            for i, p, piece in linear[j - 1]:
                through = b * p
                beta[i] += through
                n = alpha[i] * through
                if piece:
                    counts[piece] = counts.get(piece, 0.0) + n
                else:
                    for c in text[j - 1].encode("utf-8", "surrogatepass"):
                        byte_counts[c] += n

    def _expected_by_logs(self, text: str, edges: list, weight: float, counts: dict[str, float], byte_counts: np.ndarray) -> None:
        """The same sums in logarithms, for a text of any length and any pieces."""
        alpha = self.forward(edges)
        whole = alpha[-1]
        beta = [-math.inf] * len(edges) + [0.0]
        for j in range(len(edges), 0, -1):
            b = beta[j]
            if b == -math.inf:
                continue  # no segmentation passes here
            for i, lp, piece in edges[j - 1]:
                through = b + lp
                n = weight * math.exp(alpha[i] + through - whole)
                if piece:
                    counts[piece] = counts.get(piece, 0.0) + n
                else:
                    for c in text[j - 1].encode("utf-8", "surrogatepass"):
                        byte_counts[c] += n
                low, high = (beta[i], through) if beta[i] < through else (through, beta[i])
                beta[i] = high if low == -math.inf else high + math.log1p(math.exp(low - high))

    def refit(self, counts: dict[str, float], byte_counts: np.ndarray, prior: float) -> Pieces:
        """Probabilities from expected counts, the present ones being worth `prior` uses."""
        total = sum(counts.values()) + float(byte_counts.sum()) + prior
        logs = {p: math.log((counts.get(p, 0.0) + prior * math.exp(lp)) / total) for p, lp in self.logs.items()}
        return Pieces(logs, [math.log((float(n) + prior * math.exp(lp)) / total) for n, lp in zip(byte_counts, self.byte_logs, strict=True)])


def as_text(token: bytes) -> str:
    return token.decode("utf-8", "replace")


def count_tokens(docs: DataFrame, trains: Column, text: str = "text") -> DataFrame:
    """(token binary, c, n): occurrences in training texts and in all. A-Z are folded; each text has one END."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), trains.alias("trains"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, others = Counter(), Counter()

        def handed() -> pa.RecordBatch:
            names = list(learned.keys() | others.keys())
            c = [learned[t] for t in names]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(c, pa.int64()), pa.array([x + others[t] for x, t in zip(c, names, strict=True)], pa.int64())], ["token", "c", "n"])
            learned.clear(), others.clear()
            return out

        for b in batches:
            for body, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = learned if own else others
                counts.update(body.lower().split())
                counts[END] += 1
                if len(learned) + len(others) > HELD:
                    yield handed()
        if learned or others:
            yield handed()

    return rows.mapInArrow(count, "token binary, c bigint, n bigint").groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, pieces: Pieces, rounds: int = 1, prior: float = 1000.0) -> Pieces:
    """Pieces refitted to the training words. A round is one pass over the distinct words; a row for each piece comes back."""
    words = counts.where(F.col("c") > 0).where(F.col("token") != F.lit(END)).select("token", "c")
    for _ in range(rounds):
        held = counts.sparkSession.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, out, byte_out = held.value, {}, np.zeros(256)
            for b in batches:
                for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own.expected(as_text(t), c, out, byte_out)
            names = [*out, *(f"\x00{i}" for i in range(256))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*out.values(), *byte_out.tolist()], pa.float64())], ["piece", "uses"])

        found = {r["piece"]: r["uses"] for r in words.mapInArrow(expect, "piece string, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
        byte_uses = np.array([found.pop(f"\x00{i}", 0.0) for i in range(256)])
        pieces = pieces.refit(found, byte_uses, prior)
    return pieces


def scored_tokens(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds lattice: the log10 probability of each word."""
    held = counts.sparkSession.sparkContext.broadcast(pieces)
    kind = "token binary, c bigint, n bigint, lattice double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = [0.0 if t == END else held.value.log_probability(as_text(t)) / LOG10 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logs, pa.float64())], ["token", "c", "n", "lattice"])

    return counts.select("token", "c", "n").mapInArrow(score, kind)


def score_texts(docs: DataFrame, held_out: Column, pieces: Pieces, rounds: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from rows that are not held out. base_score is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))); score is the log10
    probability of the text under the model. A null text counts as empty and has one token, its end. Without training texts all counts
    are zero and a text ends after each word with probability one half."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out.alias("held_out"))
    counts = materialise(count_tokens(rows, ~F.col("held_out")))
    facts = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(F.col("token") == F.lit(END), F.col("c"))).alias("ends")).first()
    total, distinct, ends = facts["n"] or 0, facts["v"], facts["ends"] or 0
    vocabulary = materialise(scored_tokens(counts, fit_pieces(counts, pieces, rounds)))
    stop = min(ends / total, 0.999) if total and ends else 0.5
    bottom, go, halt = math.log10(total + 0.1 * (distinct + 1)), math.log10(1 - stop), math.log10(stop)
    frequent = vocabulary.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token", "c", "lattice").collect()
    known = {bytes(r["token"]): (math.log10(r["c"] + 0.1), halt if r["token"] == END else r["lattice"] + go, r["c"] > 0) for r in frequent}
    held = docs.sparkSession.sparkContext.broadcast(known)
    kind = dict(rows.dtypes)["doc_id"]
    body = rows.select(F.monotonically_increasing_id().alias("k"), "doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    columns = ["k", "doc_id", "held_out", "token", "times", "n_tokens", "n_known", "base", "score"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = held.value.get
        for b in batches:
            heads, rest_k, rest_t, rest_n = [], [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = Counter(text.lower().split())
                words[END] = 1
                tokens = seen = 0
                base = score = 0.0
                for t, n in words.items():
                    f = find(t)
                    if f is None:
                        rest_k.append(k), rest_t.append(t), rest_n.append(n)
                    else:
                        base += n * f[0]
                        score += n * f[1]
                        seen += n * f[2]
                    tokens += n
                heads.append((tokens, seen, base, score))
            n = len(heads)
            a = [pa.array(x, t) for x, t in zip(zip(*heads, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)] if heads else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), *a], columns)
            for s in range(0, len(rest_k), 50_000):
                m = len(rest_k[s : s + 50_000])
                none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rest_k[s : s + m], pa.int64()), pa.nulls(m, b.column(1).type), pa.nulls(m, pa.bool_()), pa.array(rest_t[s : s + m], pa.binary()), pa.array(rest_n[s : s + m], pa.int32()), *none], columns
                )

    parts = body.mapInArrow(part, f"k bigint, doc_id {kind}, held_out boolean, token binary, times int, n_tokens bigint, n_known bigint, base double, score double")
    parts = materialise(parts)
    heads = parts.where("token is null").select("k", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    looked = parts.where("token is not null").select("k", "token", "times").join(vocabulary.select("token", "c", "lattice"), "token")
    tails = looked.select(
        "k",
        F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0)).cast("long").alias("n_known"),
        (F.col("times") * F.log10(F.col("c") + F.lit(0.1))).alias("base"),
        (F.col("times") * (F.col("lattice") + F.lit(go))).alias("score"),
    )
    sums = heads.unionByName(tails, allowMissingColumns=True).groupBy("k").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score")
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), "score")
