"""Query op6_chat: every conversation as a preference pair against itself with its neighbour's last reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.llm.chat import format_preferences, turns_of, with_borrowed_reply
from serieslab.llm.common import table


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_borrowed_reply(turns_of(table(spark, sf_dir, "conversations")))
    spell = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    out = format_preferences(pairs)
    return out.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", spell("chosen_spans").alias("chosen_spans"), "rejected", spell("rejected_spans").alias("rejected_spans"))


def _sql() -> str:
    clean = lambda c: f"replace(replace({c}, '<|', '<'), '|>', '>')"
    line = lambda t: f"('<|' || {clean(t + '.role')} || '|>' || chr(10) || {clean(t + '.text')} || chr(10) || '<|end|>' || chr(10))"
    text = lambda c: f"coalesce(array_to_string(list_transform({c}, lambda t: {line('t')}), ''), '')"
    before = lambda c: f"coalesce(list_sum(list_transform(list_slice({c}, 1, i - 1), lambda t: length({line('t')}))), 0)::BIGINT"
    spans = lambda c: (
        f"coalesce(array_to_string(list_transform(list_filter(range(1, len({c}) + 1), lambda i: {c}[i].role = 'assistant'), "
        f"lambda i: ({before(c)} + length({clean(c + '[i].role')}) + 5) || ':' || ({before(c)} + length({line(c + '[i]')}))), ','), '')"
    )
    return f"""
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS c FROM d GROUP BY conv_id),
n AS (SELECT conv_id, c, list_max(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant')) AS last FROM t),
b AS (SELECT a.conv_id, a.c, a.last, o.c[o.last].text AS reply FROM n a LEFT JOIN n o ON o.conv_id = xor(a.conv_id, 1)),
p AS (SELECT conv_id, c, CASE WHEN last IS NULL OR reply IS NULL THEN [] ELSE list_transform(range(1, len(c) + 1),
  lambda i: {{'role': c[i].role, 'text': CASE WHEN i = last THEN reply ELSE c[i].text END}}) END AS r FROM b),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, len(c))::INTEGER AS n_common FROM p),
s AS (SELECT conv_id, n_common, list_slice(c, 1, n_common) AS p, list_slice(c, n_common + 1, len(c)) AS c, list_slice(r, n_common + 1, len(r)) AS r FROM k)
SELECT conv_id, n_common, {text('p')} AS prompt, {text('c')} AS chosen, {spans('c')} AS chosen_spans, {text('r')} AS rejected, {spans('r')} AS rejected_spans FROM s"""


QUERIES = {"op6_chat": op6_chat}
ORACLE_SQL = {"op6_chat": _sql()}
