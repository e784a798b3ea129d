"""Connected components as Spark joins: labels travel along links and jump through labels until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evertally.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node of the component.

    Every round, a node takes the smallest label among itself and its neighbours, and then the label of its
    label, so that long chains shrink by more than one link a round. Empty links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left")
        step = step.select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = step.select(F.col("node").alias("above"), F.col("label").alias("top"))
        step = step.join(above, F.col("label") == F.col("above"), "left")
        step = step.select("node", F.least("label", "top").alias("label"), (F.least("label", "top") != F.col("old")).alias("moved"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels
