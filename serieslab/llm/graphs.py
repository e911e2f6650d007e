"""Connected components of an edge table, by contraction: every node hooks to its least neighbour, trees are flattened by pointer
doubling, edges are drawn again between the roots, until none is left. All steps are joins and aggregates with partial sums; the
rounds needed grow with the logarithm of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import materialise


def _flattened(parents: DataFrame) -> DataFrame:
    """(node, parent) with every parent replaced by its tree's root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = materialise(
            parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved"))
        )
        parents = jumped.select("node", "parent")
        if jumped.where("moved").limit(1).count() == 0:
            return parents


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node. Loops and repeated edges do no harm; edges with
    a null end are left out; an empty table gives an empty one."""
    left = materialise(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null"))
    rounds: list[DataFrame] = []
    while True:
        ends = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("parent"))
        parents = _flattened(materialise(parents))
        rounds.append(parents)
        a = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        left = materialise(left.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        if left.limit(1).count() == 0:
            break
    out = rounds[0].select("node", F.col("parent").alias("component"))
    for r in rounds[1:]:
        out = out.join(r.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return out
