"""Connected components of a graph given as edges, by hooking to the smallest neighbour and jumping to the label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: the smallest id reachable, for every id that has an edge. Labels are written each round; nothing is collected.

    Every round takes the least label among a node's neighbours and then that label's own label, so that chains shorten by
    half. An edge table without rows gives no rows; edges may repeat, in either direction.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = staged(one.union(one.select("v", "u")).distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "id").select("id", F.least("component", "c").alias("c"), "component")
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("higher"))
        moved = staged(hooked.join(up, "c", "left").select("id", F.least("c", "higher").alias("component"), F.col("component").alias("before")), "labels")
        labels = moved.select("id", "component")
        if not moved.where("component <> before").limit(1).count():
            return labels
