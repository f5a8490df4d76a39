"""Connected components of a table of links, by contraction.

Every node takes the least of itself and its neighbours, twice over; links between what nodes
took make the next, smaller graph. Each step is two joins and a group-by, written to the shared
folder, so neither links nor components pass the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.sources.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """node and root (one node of its component) for every node of links (a, b: long).

    Links may repeat, go both ways or join a node to itself; null ends are ignored; without
    links the result is empty.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "least"
        )
        again = least.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = materialize(least.join(again.hint("merge"), "to").select("node", F.col("far").alias("to")), "step")
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            moved = labels.join(step.select(F.col("node").alias("root"), "to").hint("merge"), "root", "left")
            labels = materialize(moved.select("node", F.coalesce("to", "root").alias("root")), "labels")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x")).hint("merge")
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y")).hint("merge")
        edges = edges.join(left, "a").join(right, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        )
        edges = materialize(edges.distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
