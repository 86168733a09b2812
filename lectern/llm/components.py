"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label of
    that label, so paths shorten by halves; it ends when no label falls.  Sums and
    minima are combined before each shuffle, so a hub costs one row for each task.
    Self loops, repeated and reversed edges change nothing; null ends are dropped.
    """
    both = edges.select("a", "b").where("a is not null and b is not null")
    both = materialise(both.union(both.select("b", "a")).union(both.select("a", "a")).union(both.select("b", "b")).toDF("a", "b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(near.join(jump, "label", "left").select("node", F.least("label", "next").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label < old").limit(1).count()
        drop_scratch(labels)
        labels = new
        if not changed:
            drop_scratch(both)
            return labels
