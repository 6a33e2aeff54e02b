"""Connected components of an edge table, wholly as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import Store


def components(store: Store, name: str, edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    Each round takes the least label of the neighbours, then the label of that label, so that chains
    shrink by halves; every round is a table in the shared folder. Neighbours meet by partial minima,
    never as a list, so a hub does not gather in one task.
    """
    both = store.put(f"{name}-edges", edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = store.put(f"{name}-0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels, both.a == labels.node)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = step.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old")
        written = store.put(f"{name}-{turn}", jumped)
        moved = written.filter("label <> old").limit(1).count()
        store.drop(f"{name}-{turn - 1}")
        labels = written.select("node", "label")
        if not moved:
            return labels
