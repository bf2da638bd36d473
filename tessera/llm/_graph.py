"""Connected components on DataFrames, by hooking to the least neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root names the component.

    Each round every node points to its least neighbour (or itself), pointers are jumped
    once, and edges are contracted along them. Minima combine before the shuffle, joins are
    plain sort-merge joins that adaptive execution can split, so a hub node is no hot task.
    Nothing is collected; each round is written to the shared folder.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    mapping: DataFrame | None = None
    while left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), "cc-parent")
        jump = parent.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        parent = written(parent.join(jump, parent.up == jump.mid).select("node", F.col("top").alias("up")), "cc-jump")
        of_a, of_b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        contracted = left.join(of_a, "a").join(of_b, "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).where("a <> b")
        left = written(contracted.distinct(), "cc-edges")
        if mapping is None:
            mapping = parent.select("node", F.col("up").alias("root"))
        else:
            step = parent.select(F.col("node").alias("mid"), F.col("up").alias("top"))
            mapping = written(mapping.join(step, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("top", "root").alias("root")), "cc-mapping")
    if mapping is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
