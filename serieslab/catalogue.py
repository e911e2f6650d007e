"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_rolling", "q_samples", "q_metrics", "q_tables", "q_flagship")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"serieslab.plans.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship"](spark, sf_dir)
