"""Stages composed to a run: each names the columns that it needs and turns a series frame into another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from serieslab.core import materialise


@dataclass(frozen=True)
class Stage:
    name: str
    requires: tuple[str, ...]
    apply: Callable[[DataFrame], DataFrame]


def written(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows as a table, and their number as observed while they were written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def run_stages(df: DataFrame, stages: list[Stage]) -> tuple[DataFrame, DataFrame | None]:
    """(result, a row of counts for each stage). A stage whose columns are missing is refused before it runs. Every stage is written once, and
    counted by that write."""
    log: list[tuple] = []
    df, n = written(df)
    for s in stages:
        missing = [c for c in s.requires if c not in df.columns]
        if missing:
            raise ValueError(f"{s.name} needs {', '.join(missing)}")
        after, m = written(df.transform(s.apply))
        log.append((s.name, n, m, len(df.columns), len(after.columns), ",".join(c for c in after.columns if c not in df.columns)))
        df, n = after, m
    kind = "stage string, rows_before long, rows_after long, cols_before int, cols_after int, new_cols string"
    return df, df.sparkSession.createDataFrame(log, kind) if log else None
