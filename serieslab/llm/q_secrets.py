"""Query op1_secrets: secrets in every whole text of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm.common import table
from serieslab.llm.secrets import ALL_RULES, BASE_RULES, scan_secrets, spelled


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE_RULES))

    def count(kind: int) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secret_spans")).alias("spans"))


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    steps, parts = [], []
    for i, r in enumerate(ALL_RULES):
        p = quote(r.pattern)
        steps.append(
            f"regexp_extract_all(t, '{p}', 0) AS w{i}, regexp_extract_all(t, '{p}', {r.group}) AS o{i}, "
            f"regexp_split_to_array(t, '{p}') AS b{i}"
        )
        start = f"(list_sum(list_transform(list_slice(b{i}, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(w{i}, 1, k - 1), lambda x: length(x))), 0))::BIGINT"
        parts.append(
            f"list_transform(list_filter(range(1, len(w{i}) + 1), lambda k: length(o{i}[k]) >= {r.least}), "
            f"lambda k: {{'s': {start}, 'k': {i}, 'e': {start} + length(w{i}[k])}})"
        )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in ALL_RULES) + "]"
    spell = lambda of: f"array_to_string(list_transform({of}, lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"len(list_filter(o{i}, lambda x: length(x) >= {r.least}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(steps)} FROM d),
s AS (SELECT *, list_sort(flatten([{', '.join(parts)}])) AS spans_all FROM m)
SELECT doc_id, {counts},
  sha256(coalesce({spell(f'list_filter(spans_all, lambda x: x.k < {len(BASE_RULES)})')}, '')) AS base_sha256,
  coalesce({spell('spans_all')}, '') AS spans
FROM s"""


QUERIES = {"op1_secrets": op1_secrets}
ORACLE_SQL = {"op1_secrets": _sql()}
