"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelscope.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)``: the smallest node that each node of a link reaches.

    Every round hangs a node below its smallest neighbour, and below that one's, and renames the ends of
    the links, so links inside a component vanish; it ends when none is left. Rounds
    are tables of ``scratch``; nothing reaches the driver but whether links are left.
    """
    ends = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low <> high").distinct()
    edges = scratch.write(ends, "edges")
    labels = edges.select(F.explode(F.array("low", "high")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        below = edges.groupBy("high").agg(F.min("low").alias("to"))
        above = below.select(F.col("high").alias("to"), F.col("to").alias("top"))
        moved = scratch.write(below.join(above, "to", "left").select("high", F.coalesce("top", "to").alias("to")), "moved")

        def renamed(frame: DataFrame, column: str, moved: DataFrame = moved) -> DataFrame:
            known = moved.select(F.col("high").alias(column), "to")
            return frame.join(known, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        left = renamed(renamed(edges, "low"), "high").select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))
        edges = scratch.write(left.filter("low <> high").distinct(), "edges")
        labels = scratch.write(renamed(labels, "label").select("node", "label"), "labels")
    return labels
