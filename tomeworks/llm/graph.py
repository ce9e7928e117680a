"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeworks.session import discard, stored


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """((node, component), path of that table) of the edges (a, b); component is the smallest node it holds.

    Every round takes the smallest label among a node's neighbours and then that label's own label, so long chains
    halve. Each round's labels are written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    both, both_at = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels, at = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        own = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new, new_at = stored(low.join(own, "low").select("node", F.least("low", "jump").alias("label"), F.col("label").alias("old")), "labels")
        changed = new.filter("label <> old").limit(1).count()
        discard(spark, at)
        labels, at = new.select("node", "label"), new_at
        if not changed:
            discard(spark, both_at)
            return labels.select("node", F.col("label").alias("component")), at
