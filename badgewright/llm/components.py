"""Connected components of a graph given as edges, with hot nodes and no edge on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from badgewright.llm.shared import salted_join
from badgewright.sources.files import materialised


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node of its component.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    paths shorten by half at least. Every round is written, which cuts the lineage. The only thing the driver
    sees is whether a label changed. No edges give no rows.
    """
    both = edges.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = materialised(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = materialised(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("label")), "labels")
    while True:
        seen = salted_join(both, labels.select(F.col("node").alias("other"), "label"), "other", "node")
        near = seen.groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        step = materialised(step, "labels")
        if step.where("via < old").isEmpty():
            return labels
        top = step.select(F.col("node").alias("via"), F.col("via").alias("label"))
        labels = materialised(salted_join(step, top, "via", "node").select("node", "label"), "labels")
