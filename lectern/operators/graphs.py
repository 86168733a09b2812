"""Connected components of an edge table too large for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_scratch, materialise


def contracted(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(a, b): for the nodes of each task's edges, the smallest node that these edges reach; at most ``most`` nodes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            nodes = np.fromiter(parent, np.int64, len(parent))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([root(x) for x in nodes.tolist()], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            if len(parent) > most:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b: long); label is the smallest node reachable.

    Each task first joins what its own edges reach.  Then nodes take the smallest label of
    their neighbours and that label's own, until none falls; minima are combined before each
    shuffle, so a hub costs a row for each task.
    """
    stars = materialise(contracted(edges))
    links = materialise(stars.union(stars.select("b", "a")).union(stars.select("b", "b")).toDF("a", "b").distinct())
    labels = materialise(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = links.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialise(near.join(jump, "label").select("node", F.least("label", "next").alias("label")))
        falls = new.join(labels.withColumnRenamed("label", "old"), "node").where("label < old").limit(1).count()
        drop_scratch(labels)
        labels = new
        if not falls:
            drop_scratch(links)
            drop_scratch(stars)
            return labels
