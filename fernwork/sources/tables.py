"""The driver's tables as a property graph, and file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernwork.operators.catalog import Catalog
from fernwork.session import Database


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; the schema is given, so the data is read once."""
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="errorifexists")


def next_orders(orders: DataFrame) -> DataFrame:
    """Order to the same customer's next order, with a strength that depends on the order's key."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    strength = F.lit(0.125) + F.pmod(F.col("o_orderkey"), F.lit(64)) / 8.0
    return orders.select("o_orderkey", F.lead("o_orderkey").over(w).alias("next_key"), strength.alias("pheromone")).where("next_key IS NOT NULL")


def trade(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Customers' nation to suppliers' nation with the number of lines; 625 rows at most."""
    lines = lineitem.select("l_orderkey", "l_suppkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    counts = lines.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("lines"))
    return counts.withColumn("pheromone", F.lit(0.125) + F.pmod("lines", F.lit(64)) / 8.0)


#: Catalogs by application and folder: tables' schemas are read once, data whenever a query runs.
_catalogs: dict[tuple[str, str], Catalog] = {}


def load(spark: SparkSession, folder: str) -> Database:
    """Collections Customer, Orders, Lineitem, Part, Supplier, Nation, Region, Event; edge types between them."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _catalogs:
        _catalogs[key] = described(spark, folder)
    return Database(spark, _catalogs[key].copy())


def described(spark: SparkSession, folder: str) -> Catalog:
    c = Catalog()
    t = {name: table(spark, folder, name) for name in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events")}
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        c.add(name.capitalize(), t[name], key)
    c.add("Lineitem", t["lineitem"])
    c.add("Event", t["events"], "event_id")
    line = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    c.add_edge("PLACED", t["orders"].select("o_custkey", F.col("o_orderkey").alias("key")), "o_custkey", "key", "Customer", "Orders", ("target", "o_custkey"))
    c.add_edge("CONTAINS", line, "l_orderkey", "l_partkey", "Orders", "Part")
    c.add_edge("SHIPPED_BY", line.select("l_orderkey", "l_suppkey", "l_quantity"), "l_orderkey", "l_suppkey", "Orders", "Supplier")
    c.add_edge("SUPPLIED_BY", line.select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey", "Part", "Supplier")
    c.add_edge("LIVES_IN", t["customer"].select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", "Customer", "Nation", ("source", "c_nationkey"))
    c.add_edge("SITS_IN", t["supplier"].select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", "Supplier", "Nation", ("source", "s_nationkey"))
    c.add_edge("PART_OF", t["nation"].select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", "Nation", "Region", ("source", "n_regionkey"))
    c.add_edge("TRIGGERED", t["events"].select("user_id", F.col("event_id").alias("key"), "event_type"), "user_id", "key", "Customer", "Event", ("target", "user_id"))
    c.add_edge("NEXT", next_orders(t["orders"]), "o_orderkey", "next_key", "Orders", "Orders")
    c.add_edge("TRADES", trade(t["customer"], t["orders"], t["lineitem"], t["supplier"]), "c_nationkey", "s_nationkey", "Nation", "Nation")
    return c
