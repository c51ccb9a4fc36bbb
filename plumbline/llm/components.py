"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v: long); a component is its smallest node.

    Each round points every node at its smallest neighbour or itself, shortens the chains, renames the nodes by
    their targets and drops edges that became loops, so the graph shrinks until no edge is left. Minima are
    pre-aggregated before the shuffle, which keeps a node with very many edges harmless. Null ends and loops
    are ignored; every round is written to the shared folder.
    """
    both = edges.where("u is not null and v is not null")
    labels = materialise(both.select(F.col("u").alias("node")).union(both.select("v")).distinct().withColumn("component", F.col("node")), "labels")
    rest = materialise(both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while not rest.isEmpty():
        around = rest.union(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        target = materialise(around.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "targets")
        for _ in range(2):
            onward = target.select(F.col("u").alias("to"), F.col("to").alias("next"))
            target = target.join(onward, "to").select("u", F.col("next").alias("to"))
        target = materialise(target, "targets")
        renamed = target.select(F.col("u").alias("component"), F.col("to"))
        labels = materialise(labels.join(renamed, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = rest.join(target.select("u", F.col("to").alias("a")), "u").join(target.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        rest = materialise(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    return labels
