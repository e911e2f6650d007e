"""Query op13_divergence: how far the sources of documents differ within each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieslab.llm.common import table
from serieslab.llm.divergence import audit_sources

#: Least documents of a term, smoothing and ranks of terms.
LEAST, SMOOTHING, TOP = 30, 5, 50


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), least=LEAST, smoothing=SMOOTHING, top=TOP)


_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + {SMOOTHING})) // (gt.n::HUGEINT + {SMOOTHING} * v.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + {SMOOTHING})) // (v.n::HUGEINT + {SMOOTHING} * v.v) AS q
  FROM gt JOIN v ON gt.lang = v.lang JOIN k ON k.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allp AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE cnt > 0 AND p > q),
x AS (SELECT * FROM allp UNION ALL SELECT * FROM t)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x
QUALIFY part = 'pair' OR rank <= {TOP}"""

QUERIES = {"op13_divergence": op13_divergence}
ORACLE_SQL = {"op13_divergence": _SQL}
