"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.store import Workspace


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); component is the smallest node it can reach.

    Every round takes the least label among the neighbours, then the label of that label, so long chains
    shrink fast. Rounds are written; only the number of changed rows reaches the driver. A node with very many
    links is one key of a join of rows by key, which adaptive execution splits, and of a partial aggregate.
    """
    both = ws.table(links.union(links.select("b", "a")).where("a <> b").distinct())
    labels = ws.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        of_label = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        moved = ws.table(
            step.join(of_label, "label", "left").select("node", "old", F.least("label", "next").alias("component"))
        )
        ws.drop(labels)
        labels = moved.select("node", "component")
        labels._workspace_path = moved._workspace_path
        if moved.where("component <> old").isEmpty():
            return labels
