"""Query op11_importance: documents drawn by how much their words look like those of benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieslab.llm.common import table
from serieslab.llm.importance import drawn, importance_scores

#: Buckets, share drawn, least words and seed of the query.
BUCKETS, PERCENT, LEAST, SEED = 10_000, 10, 20, "2024"


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), lengths=(1, 1), buckets=BUCKETS, seed=SEED)
    return drawn(scored, PERCENT, LEAST).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT {_WORDS} AS ws FROM benchmark),
wd AS (SELECT r, unnest(ws) AS w FROM d), wb AS (SELECT unnest(ws) AS w FROM b),
u AS (SELECT DISTINCT w FROM wd UNION SELECT DISTINCT w FROM wb),
t8 AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS tab FROM range(256) x(i)),
cb AS (SELECT w, xor(list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT),
  lambda c, b: xor(tab[(xor(c & 255, b) + 1)::INT], c // 256), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM u, t8),
s AS (SELECT bucket, count(*) AS n FROM wd JOIN cb USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM wb JOIN cb USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS}) / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM wd JOIN cb USING (w) JOIN g USING (bucket) GROUP BY r),
o AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
p AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM o),
q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST} ORDER BY score DESC, doc_id NULLS FIRST, n_features DESC) AS k FROM p)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {LEAST} AND k <= (SELECT count(*) FROM p WHERE n_features >= {LEAST}) * {PERCENT} // 100 THEN k END AS rank FROM q"""

QUERIES = {"op11_importance": op11_importance}
ORACLE_SQL = {"op11_importance": _SQL}
