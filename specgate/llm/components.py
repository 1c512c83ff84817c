"""Connected components of an edge table by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgate.llm.common import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, component) for every end of `edges` (a, b), component being the least vertex that links reach.

    Each round takes the least label among a vertex's neighbours, then the label of its label, so paths shrink
    by more than half. The label table is written every round, which cuts the lineage.
    """
    both = scratch.write(edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
                         .union(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct())
    labels = scratch.write(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("component")))
    while True:
        seen = both.join(labels.select(F.col("v").alias("u"), F.col("component").alias("theirs")), "u").groupBy("v").agg(F.min("theirs").alias("theirs"))
        nearer = scratch.write(labels.join(seen, "v").select("v", F.least("component", "theirs").alias("nearer"), "component"))
        jump = nearer.select(F.col("v").alias("nearer"), F.col("nearer").alias("farther"))
        after = scratch.write(nearer.join(jump, "nearer").select("v", F.col("farther").alias("component"),
                                                                 (F.col("farther") != F.col("component")).alias("changed")))
        scratch.drop(labels, nearer)
        labels = after
        if labels.filter("changed").isEmpty():
            scratch.drop(both)
            return labels.select("v", "component")
