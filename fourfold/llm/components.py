"""Connected components of an edge table, by least neighbouring label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, label) per node of ``edges``; label is the least node of its component.

    Each round takes the least label among the neighbours (an aggregation that combines before it shuffles) and
    then the label's own label, so star-like graphs end in a few rounds. Each round is kept in the shared folder.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label"), F.lit(True).alias("moved")))
    while not labels.where("moved").isEmpty():
        now = labels.select(F.col("node").alias("v"), "label")
        near = both.join(now, "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = cut(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")).select("node", "label", (F.col("label") != F.col("was")).alias("moved")))
    return labels.select("node", "label")
