"""Connected components of an edge list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.session import materialise

ROWS = 500_000  # of a written part, so that late rounds do not write many small files


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b); root names the component.

    Each round joins every node to its least neighbour and drops the edges that
    this closes.  Nodes should be hashes: with labels in random order a
    constant share of the nodes goes each round, also along a chain.
    """
    edges = materialise(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    steps: list[DataFrame] = []
    while n := edges.count():
        parts = -(-n // ROWS)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        steps.append(materialise(least.coalesce(parts), "least"))
        left = steps[-1].select("a", F.col("to").alias("x"))
        right = steps[-1].select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = materialise(
            moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().coalesce(parts), "edges"
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        found = found.join(step.withColumnRenamed("a", "root"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return materialise(found, "roots")
