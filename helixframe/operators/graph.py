"""Connected components of general edges, for locus grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder


def reliable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def label_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``nodes`` (node) with ``label``, the least node that edges (a, b) connect it to.

    Each round takes the least label of the neighbours and then that label's own label, so chains shorten by half.
    """
    both = reliable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = reliable(nodes.select("node", F.col("node").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("b"), "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        jump = low.select(F.col("node").alias("via"), F.col("label").alias("up"))
        new = reliable(low.join(jump, F.col("label") == F.col("via"), "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels
    raise RuntimeError(f"labels didn't settle in {max_rounds} rounds")
