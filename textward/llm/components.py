"""Connected components of an edge table by Spark joins.

Each round gives every node the least label among itself and its neighbours (a partial aggregation before the shuffle,
so a hub's edges are not gathered) and then the label of its label. A round's result is a written table. Rounds grow
with the logarithm of a path's length or so. Self-loops make a component of one node; an empty table has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm._shared import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component, for each node of the edges (a, b), which are longs."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "cc-edges")
    now = cut(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("root")), "cc")
    while True:
        near = both.join(now.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("best"))
        step = now.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "best").alias("root"))
        step = cut(step, "cc")
        jumped = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", "old", F.least("root", "further").alias("root"))
        done = cut(jumped, "cc")
        changed = done.where("root <> old").limit(1).count()
        forget(now)
        forget(step)
        now = done
        if not changed:
            forget(both)
            return now.select("node", "root")
