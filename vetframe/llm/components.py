"""Connected components of a graph given as edges.

Every node takes the smallest label among its own and its neighbours', then the label of that
label, until nothing changes. Each round is a few joins and a grouped minimum (summed up before the
shuffle), and its result is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges`` (a, b): the smallest node of the component.

    Nodes are of any ordered type; loops and repeated edges do no harm; null ends are left out.
    """
    ends = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(
        ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("component")
        ),
        "labels",
    )
    while True:
        # 1. The smallest label among the neighbours.
        of_neighbour = labels.select(F.col("node").alias("b"), F.col("component").alias("_near"))
        near = both.join(of_neighbour, "b").groupBy(F.col("a").alias("node")).agg(
            F.min("_near").alias("_near")
        )
        nearest = labels.join(near, "node").select(
            "node", F.col("component").alias("_was"),
            F.least("component", "_near").alias("_label"),
        )
        # 2. The label that this label has.
        of_label = labels.select(F.col("node").alias("_label"), F.col("component").alias("_next"))
        step = stored(
            nearest.join(of_label, "_label").select(
                "node", F.least("_label", "_next").alias("component"), "_was"
            ),
            "labels",
        )
        changed = step.where(F.col("component") != F.col("_was")).limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
