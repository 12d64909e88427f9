"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of ``edges(a, b)``; the label is the smallest id of the component.

    Each round takes the least label among a vertex and its neighbours, then the label of that label;
    rounds grow with the logarithm of the diameter. Each round is written to the shared folder.
    Self-loops and repeated edges change nothing; an edge with a null end is left out; no edges, no rows.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(both.union(both.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "label")
        least = near.union(labels).groupBy("v").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        moved = least.join(jump, "label", "left").select("v", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = written(moved, "cc-labels")
        if new.join(labels.withColumnRenamed("label", "was"), "v").where("label <> was").isEmpty():
            return new
        labels = new
