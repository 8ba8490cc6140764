"""Degrees, neighbours and summary figures of graphs and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.operators.catalog import Catalog, EdgeType


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct pairs."""
    return edges.select("_src", "_dst").distinct()


def between(edges: DataFrame, source: int, target: int) -> DataFrame:
    return edges.where((F.col("_src") == source) & (F.col("_dst") == target))


def degrees(edges: DataFrame, direction: str = "out", hubs: bool = False) -> DataFrame:
    """edges (_src, _dst, _type): (node, degree), the number of different neighbours per type, over types and directions.

    Rows are shuffled once, by vertex. Where single vertices hold a large part of all edges, `hubs` makes neighbours
    different before, spread by vertex and neighbour, at the price of a second shuffle."""
    ways = {"out": (("_src", "_dst"),), "in": (("_dst", "_src"),), "both": (("_src", "_dst"), ("_dst", "_src"))}[direction]
    sides = [edges.select(F.col(a).alias("node"), F.col(b).alias("other"), "_type", F.lit(a).alias("way")) for a, b in ways]
    met = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
    if hubs:
        return met.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return met.repartition("node").groupBy("node").agg(F.count_distinct("_type", "way", "other").alias("degree"))


def all_edges(catalog: Catalog) -> DataFrame:
    """(_src, _dst, _type, pheromone) of all edge types; the starting strength where a type keeps none."""
    parts = []
    for e in catalog.edges.values():
        df = e.ends()
        strength = F.col("pheromone").cast("double") if "pheromone" in df.columns else F.lit(1.0)
        parts.append(df.select(F.col("_src").cast("bigint"), F.col("_dst").cast("bigint"), F.lit(e.name).alias("_type"), strength.alias("pheromone")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def all_entities(catalog: Catalog) -> DataFrame:
    """(_id, _type, properties): every row with its properties that aren't null, as a map of strings."""
    out = None
    for c in catalog.collections.values():
        rest = [x for x in c.df.columns if x != c.key]
        props = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(x).alias("key"), F.col(f"`{x}`").cast("string").alias("value")) for x in rest]), lambda x: x["value"].isNotNull())) if rest else F.create_map().cast("map<string,string>")
        one = c.df.select(F.col(c.key).cast("bigint").alias("_id") if c.key else F.lit(None).cast("bigint").alias("_id"), F.lit(c.name).alias("_type"), props.alias("properties"))
        out = one if out is None else out.union(one)
    return out


def graph_stats(catalog: Catalog) -> DataFrame:
    """One row: entities, edges, collections, avg_pheromone."""
    counts = None
    for c in catalog.collections.values():
        one = c.df.agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.union(one)
    entities = counts.agg(F.sum("n").alias("entities"))
    edges = all_edges(catalog).agg(F.count(F.lit(1)).alias("edges"), F.avg("pheromone").alias("avg_pheromone"))
    return entities.join(F.broadcast(edges)).withColumn("collections", F.lit(len(catalog.collections)).cast("bigint"))


def dashboard(catalog: Catalog) -> DataFrame:
    """One row: entities, edges, properties (that aren't null, keys not counted), collections (that have rows)."""
    parts = None
    for c in catalog.collections.values():
        held = sum((F.count(F.col(f"`{x}`")) for x in c.df.columns if x != c.key), F.lit(0))
        one = c.df.agg(F.count(F.lit(1)).alias("n"), held.alias("p"))
        parts = one if parts is None else parts.union(one)
    out = parts.agg(F.sum("n").alias("entities"), F.sum("p").alias("properties"), F.count(F.when(F.col("n") > 0, 1)).alias("collections"))
    return out.join(F.broadcast(all_edges(catalog).agg(F.count(F.lit(1)).alias("edges"))))


def collection_stats(catalog: Catalog, name: str, edge: EdgeType | None = None) -> DataFrame:
    """One row: rows, avg_properties (that aren't null, the key not counted), avg_degree over an edge type."""
    c = catalog.collection(name)
    props = sum((F.col(f"`{x}`").isNotNull().cast("int") for x in c.df.columns if x != c.key), F.lit(0))
    out = c.df.agg(F.count(F.lit(1)).alias("rows"), F.avg(props).alias("avg_properties"))
    if edge is None:
        return out
    d = degrees(edge.ends().select("_src", "_dst").withColumn("_type", F.lit(edge.name))).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("d"))
    return out.join(F.broadcast(d)).select("rows", "avg_properties", (F.col("d") / F.col("rows")).alias("avg_degree"))
