"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathshade.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the smallest node of the component, from (a, b).

    Smallest-label propagation with pointer jumping: the rounds grow with the
    logarithm of the longest path. Each round is a written table, so no lineage
    grows; labels and edges stay distributed and joins can be split where a
    node is hot, since minima are merged before they are shuffled.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        target = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = written(lower.join(target, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
