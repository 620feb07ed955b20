"""Connected components of an edge table, by neighbour minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; ``root`` is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so long chains halve. Nothing but an emptiness test reaches the driver. Labels are
    checkpointed each round, so a lost executor costs one round.
    """
    one_way = edges.select("a", "b").filter("a <> b")
    both = cut(one_way.union(one_way.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b")
        offers = near.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_offer"))
        hooked = labels.join(offers, "node").select(
            "node", F.col("root").alias("_was"), F.least("root", "_offer").alias("_mid")
        )
        jump = labels.select(F.col("node").alias("_mid"), F.col("root").alias("_next"))
        labels = cut(hooked.join(jump, "_mid").select("node", F.least("_mid", "_next").alias("root"), "_was"))
        if labels.filter("root <> _was").isEmpty():
            return labels.drop("_was")
        labels = labels.drop("_was")
