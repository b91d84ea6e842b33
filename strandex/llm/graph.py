"""Connected components by smallest labels and pointer jumping; links stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label) for every node of an edge; label: the smallest node that its links reach."""
    both = common.saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", 1)
    rows = both.count()
    labels = common.saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels", rows=rows)
    before = None
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        to = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = common.saved(hooked.join(to, "next").select("node", "label", F.least("next", "jump").alias("next")), "labels", rows=rows)
        done = moved.where("next < label").isEmpty()
        common.used_up(before if before is not None else labels)
        labels, before = moved.select("node", F.col("next").alias("label")), moved
        if done:
            common.used_up(both)
            return labels
