"""Preference formatting of conversations, in DataFrame functions only.

Chosen and rejected conversations are arrays of turns. Their longest common prefix of turns is rendered once, as the prompt; what follows
in each is its completion, with the spans that are trained on: the turns of the trained roles, closing mark included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:int,stop:int>>"


def turns_of(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turns): each conversation's turns in order. Equal rows count once; turns with one number go by role and text; a
    turn without number comes first; null roles and texts become empty. Rows without conversation are left out: they belong to none."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.where(F.col(conversation).isNotNull()).groupBy(F.col(conversation).alias("conversation")).agg(F.array_sort(F.collect_set(one)).alias("all"))
    return grouped.select("conversation", F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    """`<|role|>`, the text and `<|end|>`, a line each. A mark inside the text loses its bar, so that no text can open or close a turn."""
    clean = lambda c: F.replace(F.replace(c, F.lit("<|"), F.lit("<")), F.lit("|>"), F.lit(">"))
    return F.concat(F.lit("<|"), clean(turn["role"]), F.lit("|>\n"), clean(turn["text"]), F.lit("\n<|end|>\n"))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_spans(turns: Column, trained: tuple[str, ...]) -> Column:
    """Spans (code points, stop exclusive) of the trained roles' turns in the rendered turns, without the line that opens them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        size = F.length(rendered(t))
        head = F.length(rendered(F.struct(t["role"].alias("role"), F.lit("").alias("text")))) - F.length(F.lit("\n<|end|>\n"))
        one = F.struct((acc["at"] + head).alias("start"), (acc["at"] + size).alias("stop"))
        return F.struct((acc["at"] + size).alias("at"), F.when(t["role"].isin(*trained), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def format_preferences(pairs: DataFrame, key: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each row of pairs: pair_id, n_common (turns), prompt, and for both sides the completion and its spans to train on.

    A missing side is an empty conversation. If one side is a prefix of the other, or both are equal, its completion is empty; without
    a common first turn the prompt is. Repeated rows repeat; other columns are not read."""
    none = F.array().cast(TURNS)
    rows = pairs.select(F.col(key).alias("pair_id"), F.coalesce(F.col(chosen).cast(TURNS), none).alias("c"), F.coalesce(F.col(rejected).cast(TURNS), none).alias("r"))
    same = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    common = F.when(same > 0, same - 1).otherwise(F.size("c")).cast("int")
    rows = rows.withColumn("n_common", common)
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    rows = rows.select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return rows.select(
        "pair_id", "n_common", joined(F.col("p")).alias("prompt"),
        joined(F.col("c")).alias("chosen"), trained_spans(F.col("c"), trained).alias("chosen_spans"),
        joined(F.col("r")).alias("rejected"), trained_spans(F.col("r"), trained).alias("rejected_spans"),
    )


def with_borrowed_reply(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """(pair_id, chosen, rejected): each conversation against itself with its last reply taken from its neighbour (the conversation with the
    other id of a pair 2k, 2k + 1). Without neighbour, or without a reply in either, there is nothing to prefer and the row has no
    rejected side. conversations: (conversation integer, turns)."""
    numbered = conversations.select(F.col("conversation").alias("pair_id"), "turns", F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == role, i))).alias("last"))
    other = numbered.select((F.col("pair_id").bitwiseXOR(F.lit(1).cast("long"))).alias("pair_id"), F.get("turns", F.col("last"))["text"].alias("reply"))
    both = numbered.join(other, "pair_id", "left")
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("last"), F.col("reply")).otherwise(t["text"]).alias("text")))
    return both.select("pair_id", F.col("turns").alias("chosen"), F.when(F.col("last").isNotNull() & F.col("reply").isNotNull(), swapped).alias("rejected"))
