"""Connected components of an edge table."""

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """node -> label (smallest node reachable) for the nodes of edges (a, b).

    Labels spread to neighbours and every round also jumps to the label of the label,
    so the number of rounds grows with the logarithm of a path. Each round is written to
    the shared folder, so that a lost executor costs one round."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node"))
                         .agg(F.min("b").alias("label"))
                         .select("node", F.least("node", "label").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        far = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut_lineage(spread.join(far, "label", "left")
                          .select("node", F.coalesce("far", "label").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
