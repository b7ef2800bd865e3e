"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(v, label) for each end of the edges (a, b): label is the smallest v of its component.

    Each round takes the smallest label among neighbours and then the label of that label, so paths halve. Every table
    is written to the shared folder before the next round reads it.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.v).groupBy(both.a.alias("w")).agg(F.min("label").alias("m"))
        lower = cut(labels.join(near, labels.v == near.w).select("v", F.least("label", "m").alias("label"), F.col("label").alias("old")))
        of = lower.select(F.col("v").alias("w"), F.col("label").alias("next"))
        jumped = cut(lower.join(of, lower.label == of.w).select("v", F.least("label", "next").alias("label"), (F.least("label", "next") < F.col("old")).alias("moved")))
        labels = jumped.select("v", "label")
        if not jumped.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
