"""Connected components of a table of links, by distributed label passing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node in ``links(a, b)``; root is the component's smallest node.

    Each round gives a node the smallest label among its neighbours and then
    its label's own label, so chains shorten by halves, however long they are.
    Labels are written to the shared folder each round, in as many parts as the
    links' number asks for; nothing is collected but whether a label moved.
    """
    size = 2 * links.count()
    both = scratch.write_rows(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), size)
    label = scratch.write_rows(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), size)
    while True:
        told = both.join(label.select("node", "root"), both.b == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        best = label.select("node", "root").join(told, F.col("node") == F.col("a"))
        best = scratch.write_rows(best.select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root")), size)
        up = best.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        moved = scratch.write_rows(best.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("upper", "root")).alias("root")), size)
        settled = moved.where("root <> old").isEmpty()
        scratch.drop(label, best)
        label = moved
        if settled:
            scratch.drop(both)
            return label
