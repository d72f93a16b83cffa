"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(scratch: Scratch, links: DataFrame, tag: str) -> DataFrame:
    """(node, comp) for every node of ``links(a, b)``; comp is the component's smallest node.

    Every step is a join and a minimum with partial aggregation over tables in the shared
    folder; nothing is collected but one count a round. No links: an empty table.
    """
    edges = scratch.save(
        links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct(),
        f"{tag}-edges",
    )
    labels = scratch.save(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("comp")), f"{tag}-0")
    step = 0
    while True:
        near = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "low").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        step += 1
        moved = scratch.save(lower.join(up, "via").select("node", "old", F.least("via", "far").alias("comp")), f"{tag}-{step}")
        changed = moved.where("comp < old").limit(1).count()
        labels = moved.select("node", "comp")
        scratch.drop(f"{tag}-{step - 1}")
        if not changed:
            return labels
