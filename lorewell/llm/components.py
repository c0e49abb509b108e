"""Connected components of a link table by label propagation with pointer jumping, one stored table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from .work import drop, row_count, stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label), label being the smallest node reachable, as a stored table. Nodes without links don't appear."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    changed = row_count(labels)
    while changed:
        far = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        nearer = labels.join(far, labels.node == far.a).select("node", "label", F.least("label", "seen").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        moved = nearer.join(jump, "new").select("node", F.col("label").alias("old"), F.least("new", "further").alias("label"))
        seen = Observation()
        before, labels = labels, stored(moved.observe(seen, F.count_if(F.col("old") != F.col("label")).alias("changed")).select("node", "label"), "labels")
        changed = seen.get.get("changed", 0)
        drop(before)
    drop(edges)
    return labels
