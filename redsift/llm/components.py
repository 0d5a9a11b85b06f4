"""Connected components by parallel hooking and shortcutting over parent arrays held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redsift.session import dropped, written


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, label)`` for every node of an edge; label: the smallest node of its component.

    Each round hooks the parent of every node, and the node, under the smallest grandparent among its neighbours, and
    shortcuts parents to grandparents, all as joins and min-aggregations; rounds grow with the logarithm of the longest
    chain. Every round's parent table is written to the shared folder, which cuts the lineage and survives lost
    executors. Edges with a null end are ignored; loops make a component of one; an empty table gives no rows.
    """
    real = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    both = written(real.unionByName(real.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    state = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("w")).select("node", F.least("node", "w").alias("p"), F.col("node").alias("g")), "parents")
    state = _grandparents(state.select("node", "p", F.col("g").alias("old")), state)
    while not state.where("g <> old").isEmpty():
        near = both.join(state.select(F.col("node").alias("v"), "g"), "v").groupBy(F.col("u").alias("node")).agg(F.min("g").alias("m"))
        now = state.drop("old").join(near, "node")
        hooked = now.select("node", F.least("p", "g", "m").alias("p"), F.col("g").alias("old")).unionByName(now.select(F.col("p").alias("node"), F.col("m").alias("p"), F.lit(None).cast("string").alias("old")))
        parents = hooked.groupBy("node").agg(F.min("p").alias("p"), F.max("old").alias("old"))
        before, parents = state, written(parents, "parents")
        state = _grandparents(parents, parents)
        dropped(edges.sparkSession, before, parents)
    dropped(edges.sparkSession, both)
    return state.select("node", F.col("g").alias("label"))


def _grandparents(state: DataFrame, parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("p"), F.col("p").alias("g"))
    return written(state.select("node", "p", "old").join(up, "p").select("node", "p", "g", "old"), "grandparents")
