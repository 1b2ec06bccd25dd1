"""Connected components of an edge table, without collecting lists or the driver's memory.

Each round hooks every vertex to its smallest smaller neighbour (a min, combined
before the shuffle), follows the pointers once, and moves the edges to what their
ends point to.  The work left shrinks with every round; tables are written to the
shared folder between rounds, so the plan stays short and lost executors cost
only their running tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import stored


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(vertex, label) of every vertex of ``edges`` (a, b: long); the label is the component's smallest vertex.

    Self-loops and repeated edges are harmless; an empty table gives an empty one;
    a vertex with only self-loops is left out.
    """
    left = stored(_ordered(edges), f"{name}-edges")
    steps: list[DataFrame] = []
    while left.take(1):
        hooks = stored(left.groupBy("a").agg(F.min("b").alias("b")), f"{name}-hooks")
        over = hooks.select(F.col("a").alias("x"), F.col("b").alias("y"))
        jumped = stored(hooks.join(over, hooks.b == over.x, "left").select("a", F.coalesce("y", "b").alias("b")), f"{name}-jumped")
        steps.append(jumped)
        to = jumped.select(F.col("a").alias("x"), F.col("b").alias("y"))
        moved = left.join(to, left.a == to.x, "left").select(F.coalesce("y", "a").alias("a"), "b")
        to = jumped.select(F.col("a").alias("x"), F.col("b").alias("y"))
        moved = moved.join(to, moved.b == to.x, "left").select("a", F.coalesce("y", "b").alias("b"))
        left = stored(_ordered(moved), f"{name}-edges")
    if not steps:
        return left.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
    labels = steps[0]
    for step in steps[1:]:
        to = step.select(F.col("a").alias("x"), F.col("b").alias("y"))
        labels = labels.join(to, labels.b == to.x, "left").select("a", F.coalesce("y", "b").alias("b")).unionByName(step)
    labels = labels.groupBy("a").agg(F.min("b").alias("b"))
    roots = labels.select(F.col("b").alias("a"), "b").distinct()
    return stored(labels.unionByName(roots).distinct().select(F.col("a").alias("vertex"), F.col("b").alias("label")), name)
