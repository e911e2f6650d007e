"""Helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.core import BROADCAST_ROWS, materialise, sized, table

__all__ = ["BROADCAST_ROWS", "WORD_SPACE", "counted", "materialise", "sized", "spread", "table", "words"]

#: White space as the word definition `[^\x20\x09-\x0D]+` has it.
WORD_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def spread(df: DataFrame, n_rows: int, keys: list[str], task_rows: int, most: int) -> DataFrame:
    """Deals rows by keys to a stated number of tasks, which adaptive execution does not merge by size: for rows that are short but take
    long to work on."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, min(most, -(-n_rows // task_rows))), *keys)


def counted(text: Column, characters: str | tuple[str, ...]) -> Column:
    """Occurrences of the given single characters, without a regular expression."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def words(text: Column) -> Column:
    """Array of `[^\\x20\\x09-\\x0D]+`."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
