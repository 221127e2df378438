"""Connected components by min-label propagation with pointer jumping; every round is a stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame], max_rounds: int = 60) -> DataFrame:
    """edges (a, b), any direction and with repeats -> (node, root): root is the least node reachable.

    Only nodes with an edge are returned. Each round takes the least label among neighbours and then the label of that
    label, so a chain of length n takes about log n rounds; rounds stop when no label changes.
    """
    both = store(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        best = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = store(best.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        labels = moved.select("node", "root")
        if not moved.where("old <> root").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
