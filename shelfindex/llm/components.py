"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node that has an edge.

    `edges` has long columns a and b. Each round gives a node the smallest label among its
    neighbours and then the label of that label, so paths shrink by doubling. Rounds go on until
    no label changes. A node with very many edges is combined before the shuffle, and its side of
    the join can be split.
    """
    both = kept(
        edges.filter("a <> b")
        .select("a", "b")
        .unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(),
        "edges",
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("label")
    )
    labels = kept(labels, "labels")
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = lower.select(F.col("node").alias("at"), F.col("next").alias("beyond"))
        moved = kept(
            lower.join(jump, F.col("next") == F.col("at")).select(
                "node",
                F.col("beyond").alias("label"),
                (F.col("beyond") != F.col("label")).alias("moved"),
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
