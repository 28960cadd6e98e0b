"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import BROADCAST_ROWS, cut_lineage, salted_join


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the least node reachable.

    Each round takes the least label of the neighbours, then the label's own label, so the
    rounds grow with the logarithm of the longest path. Joins are salted: one node may hold
    a third of all links. Lineage is cut each round.
    """
    both = cut_lineage(
        links.select("a", "b").union(links.select("b", "a")).filter(F.col("a") != F.col("b")).distinct()
    )
    few = both.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))

    def looked_up(left: DataFrame, on: str, by: str, name: str) -> DataFrame:
        """left with the label of the node in column `on`."""
        right = labels.select(F.col("node").alias(on), F.col("label").alias(name))
        return left.join(F.broadcast(right), on) if few else salted_join(left, right, [on], by, salts=8)

    for _ in range(rounds):
        near = looked_up(both, "b", "a", "_near").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        least = looked_up(near, "node", "node", "_old").select("node", F.least("_old", "_near").alias("label"), "_old")
        jumped = looked_up(least, "label", "node", "_up")  # a label is a node
        jumped = cut_lineage(jumped.select("node", F.least("label", "_up").alias("label"), "_old"))
        changed = jumped.filter(F.col("label") != F.col("_old")).limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
