"""Connected components of a link table, as Spark joins; nothing reaches the driver but one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each linked node reaches.

    Labels spread over links and then jump to their label's label, so the rounds
    grow with the logarithm of a component's breadth.  Every round is a written
    table.  Joins have one row for each node on one side, so that a hub's rows on
    the other can be split.  Nodes without links have no row.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    kept, rounds = Scratch(links.sparkSession), Scratch(links.sparkSession)
    both = kept.written(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = rounds.written(labels, "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("m"))
        spread = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("of_root"))
        jumped = spread.join(roots, F.col("component") == F.col("root"), "left").select("node", "old", F.least("component", F.coalesce("of_root", "component")).alias("component"))
        now = Scratch(links.sparkSession)
        jumped = now.written(jumped, "labels")
        rounds.clear()
        labels, rounds = jumped.select("node", "component"), now
        if jumped.where("old <> component").isEmpty():
            kept.clear()
            return labels
