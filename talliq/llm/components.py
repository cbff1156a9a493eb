"""Connected components of an edge table, by rounds of minimum labels with pointer jumping, checkpointed each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of an edge (a, b) with the smallest node of its component.

    Every round takes, for each node, the smallest label among its own and its neighbours' and then that label's label.
    A round that changes nothing ends it. All state stays in tables; a round's counts are all that reaches the driver.
    """
    both = common.checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = common.checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        jumped = step.join(of, step["label"] == of["at"], "left")
        new = common.checkpointed(jumped.select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
