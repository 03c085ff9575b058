"""Connected components of matched images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.shared import components


def biggest_component(nodes: DataFrame, edges: DataFrame, least_confidence: float = 1.0, least_size: int = 2) -> DataFrame:
    """(group, node) of the largest component of each group, ties going to the one with the smallest node.

    nodes: (group, node), node being unique over all groups; edges: (group, src, dst, confidence). Edges below the
    confidence do not count, and a component below the size is none.
    """
    linked = components(edges.where(F.col("confidence") >= least_confidence).select("src", "dst")).withColumnRenamed("label", "component")
    members = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", F.col("node").cast("long")))
    sizes = members.groupBy("group", "component").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    best = sizes.groupBy("group").agg(F.min(F.struct((-F.col("size")).alias("size"), "component")).alias("best")).select("group", F.col("best.component").alias("component"))
    return members.join(best, ["group", "component"]).select("group", "node")
