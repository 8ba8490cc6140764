"""Connected components of a graph given as a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links (x, y): table (node, root) of all their nodes; root is the smallest node that can be reached.

    Every round points each node to its smallest neighbour, follows the pointers twice and contracts the links,
    so a chain shrinks to a quarter or less; a star takes one round. Least neighbours are found by aggregation,
    so a hub costs a row per task. No links give an empty table."""
    edges = stored(links.select("x", "y").where("x <> y").distinct())
    roots = None
    while True:
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        to = stored(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")))
        for _ in range(2):
            nxt = to.select(F.col("x").alias("p"), F.col("p").alias("q"))
            to = stored(to.join(nxt, "p").select("x", F.col("q").alias("p")))
        if roots is None:
            roots = to.select(F.col("x").alias("node"), F.col("p").alias("root"))
        else:
            step = to.select(F.col("x").alias("root"), "p")
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        left, right = to.select("x", F.col("p").alias("px")), to.select(F.col("x").alias("y"), F.col("p").alias("py"))
        edges = stored(edges.join(left, "x").join(right, "y").where("px <> py").select(F.col("px").alias("x"), F.col("py").alias("y")).distinct())
        if edges.isEmpty():
            return roots


def relabel(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes (node, ...) with the column root; a node without links is its own root."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
