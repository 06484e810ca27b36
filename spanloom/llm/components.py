"""Connected components of an undirected edge table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b; bigint); component is the smallest node reachable.

    Repeated contraction: every component points to its smallest neighbour below it, chains of pointers are halved
    until they end at a root, and edges inside a component vanish.  Local minima survive a round, so the number of
    rounds is logarithmic; each settles its small tables in the shared folder.  Null ends and loops are ignored; an
    empty table gives an empty result.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        up = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        roots = edges.select(F.col("a").alias("node")).distinct().join(up, "node", "left_anti").withColumn("to", F.col("node"))
        up = settle(up.unionByName(roots))
        while True:
            over = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            longer = settle(up.join(over, "to").select("node", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            up = longer.select("node", "to")
            if longer.where("moved").isEmpty():
                break
        labels = up.withColumnRenamed("to", "component") if labels is None else settle(labels.join(up, labels["component"] == up["node"], "left").select(labels["node"], F.coalesce("to", "component").alias("component")))
        edges = settle(
            edges.join(up.select(F.col("node").alias("a"), F.col("to").alias("ca")), "a").join(up.select(F.col("node").alias("b"), F.col("to").alias("cb")), "b")
            .where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        )
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
