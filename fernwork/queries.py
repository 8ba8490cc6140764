"""Queries over the driver's tables, one or more for each kind of operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwork.operators import changes, constraints, indexes, joins, paths, pheromone, shards, stats, versions
from fernwork.operators.catalog import Catalog
from fernwork.plans import nodes as n
from fernwork.plans.parser import parse
from fernwork.registry import QUERIES, SQL, built, text  # noqa: F401
from fernwork.sources.tables import load, table
from fernwork.streaming import feeds

FLAGSHIP = """FROM Customer c TRAVERSE -[:PLACED]-> o WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 100000
SELECT c.c_nationkey AS nation, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS revenue
GROUP BY c.c_nationkey HAVING COUNT(*) > 5 ORDER BY revenue DESC, nation LIMIT 10"""


text("flagship", FLAGSHIP, """SELECT c_nationkey AS nation, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000 GROUP BY c_nationkey HAVING count(*) > 5 ORDER BY revenue DESC, nation LIMIT 10""")
# scans and conditions
text("scan_all", "FROM Nation SELECT *", "SELECT * FROM nation")
text("scan_filter_eq", "FROM Customer WHERE c_mktsegment = 'BUILDING' SELECT c_custkey, c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
text("scan_filter_range", "FROM Lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05 SELECT l_orderkey, l_linenumber, l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05")
text("filter_or_not", "FROM Orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 150000) SELECT o_orderkey", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 150000)")
text("filter_in_like_between", "FROM Part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#23') OR p_type LIKE '%BRASS%' SELECT p_partkey", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#23') OR p_type LIKE '%BRASS%'")
text("project_arith", "FROM Lineitem SELECT l_orderkey AS k, l_quantity + 1 AS plus, l_quantity - l_linenumber AS minus, l_quantity * 2 AS twice, l_quantity / (l_linenumber - 1) AS part, -l_linenumber AS neg", "SELECT l_orderkey AS k, l_quantity + 1 AS plus, l_quantity - l_linenumber AS minus, l_quantity * 2 AS twice, l_quantity / nullif(l_linenumber - 1, 0) AS part, -l_linenumber AS neg FROM lineitem")
text("project_functions", "FROM Orders SELECT o_orderkey AS k, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, LOWER(o_orderpriority) AS p, LENGTH(o_orderpriority) AS n, ROUND(o_totalprice) AS r", "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, lower(o_orderpriority) AS p, CAST(length(o_orderpriority) AS INT) AS n, round(o_totalprice) AS r FROM orders")
text("project_case", "FROM Customer SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS level", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS level FROM customer")
# aggregation
text("agg_global", "FROM Lineitem SELECT COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_quantity) AS a, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi", "SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q, avg(l_quantity) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
text("agg_empty", "FROM Lineitem WHERE l_quantity < 0 SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MAX(l_tax) AS t", "SELECT count(*) AS n, coalesce(sum(l_quantity), 0.0) AS q, max(l_tax) AS t FROM lineitem WHERE l_quantity < 0")
text("agg_group", "FROM Lineitem SELECT l_returnflag, COUNT(*), SUM(l_quantity) GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS agg_0, sum(l_quantity) AS agg_1 FROM lineitem GROUP BY l_returnflag")
text("agg_multi_key", "FROM Lineitem SELECT l_returnflag, l_linestatus, COUNT(*) AS n, AVG(l_quantity) AS a, MIN(l_shipdate) AS first GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS a, min(l_shipdate) AS first FROM lineitem GROUP BY ALL")
text("agg_having", "FROM Orders SELECT o_custkey, COUNT(*) AS n GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 250000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 250000")
text("agg_nested_expr", "FROM Lineitem SELECT l_suppkey, SUM(l_quantity) / COUNT(*) + 1 AS x GROUP BY l_suppkey", "SELECT l_suppkey, sum(l_quantity) / count(*) + 1 AS x FROM lineitem GROUP BY l_suppkey")
text("agg_by_month", "FROM Orders SELECT MONTH(o_orderdate) AS m, COUNT(*) AS n GROUP BY MONTH(o_orderdate) ORDER BY m", "SELECT CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
text("count_distinct", "FROM Lineitem SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_partkey) AS p GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag")
text("select_distinct", "FROM Part SELECT DISTINCT p_brand, p_size", "SELECT DISTINCT p_brand, p_size FROM part")
text("agg_rollup", "FROM Orders SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
text("agg_cube", "FROM Orders SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
# order and paging
text("sort_limit_offset", "FROM Orders SELECT o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
text("topk_by_hidden_key", "FROM Customer SELECT c_name ORDER BY c_acctbal DESC, c_custkey LIMIT 10", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
# traversal
text("traverse_out", "FROM Customer c TRAVERSE -[:PLACED]-> o WHERE o.o_orderstatus = 'F' SELECT c.c_custkey, o.o_orderkey", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
text("traverse_in", "FROM Nation n TRAVERSE <-[:LIVES_IN]- c SELECT n.n_name, COUNT(*) AS customers GROUP BY n.n_name", "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
text("traverse_both", "FROM Orders a TRAVERSE <-[:NEXT]-> b SELECT a.o_orderkey AS a, b.o_orderkey AS b", "WITH e AS (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) SELECT s AS a, d AS b FROM e WHERE d IS NOT NULL UNION ALL SELECT d, s FROM e WHERE d IS NOT NULL")
text("traverse_bag", "FROM Orders o TRAVERSE -[:CONTAINS]-> p SELECT o.o_orderkey, p.p_partkey", "SELECT l_orderkey AS o_orderkey, l_partkey AS p_partkey FROM lineitem")
text("traverse_untyped", "FROM Supplier s TRAVERSE --> x SELECT s.s_suppkey, x.n_name", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
text("traverse_edge_property", "FROM Orders o TRAVERSE -[e:CONTAINS]-> p WHERE e.l_quantity > 45 SELECT o.o_orderkey, p.p_partkey, e.l_quantity AS q", "SELECT l_orderkey AS o_orderkey, l_partkey AS p_partkey, l_quantity AS q FROM lineitem WHERE l_quantity > 45")
text("traverse_chain", "FROM Customer c TRAVERSE -[:PLACED]-> o TRAVERSE -[:CONTAINS]-> p WHERE p.p_size > 45 SELECT c.c_nationkey AS nation, COUNT(*) AS lines GROUP BY c.c_nationkey", "SELECT c_nationkey AS nation, count(*) AS lines FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 45 GROUP BY 1")
text("traverse_star", "FROM Customer c TRAVERSE -[:PLACED]-> o, -[:LIVES_IN]-> n WHERE o.o_totalprice > 300000 SELECT n.n_name, COUNT(*) AS n_orders GROUP BY n.n_name", "SELECT n_name, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000 GROUP BY 1")
text("traverse_strength", "FROM Orders a TRAVERSE -[:NEXT]-> b WITH PHEROMONE STRENGTH > 4.0 SELECT a.o_orderkey AS a, b.o_orderkey AS b", "WITH e AS (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) SELECT s AS a, d AS b FROM e WHERE d IS NOT NULL AND 0.125 + (s % 64) / 8.0 > 4.0")
_REACH = "WITH RECURSIVE e AS (SELECT * FROM (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) WHERE d IS NOT NULL), w AS (SELECT s AS a, d AS b, 1 AS depth FROM e UNION ALL SELECT w.a, e.d, w.depth + 1 FROM w JOIN e ON w.b = e.s {limit}) SELECT a, b, CAST(min(depth) AS INT) AS depth FROM w GROUP BY a, b"
text("traverse_var_1_3", "FROM Orders x TRAVERSE -[p:NEXT*1..3]-> y SELECT x.o_orderkey AS a, y.o_orderkey AS b, p.depth AS depth", _REACH.format(limit="WHERE w.depth < 3"))
text("traverse_reach", "FROM Orders x TRAVERSE -[p:NEXT*]-> y SELECT x.o_orderkey AS a, y.o_orderkey AS b, p.depth AS depth", _REACH.format(limit=""))
_TRADE = "t AS (SELECT c_nationkey AS s, s_nationkey AS d, 0.125 + (count(*) % 64) / 8.0 AS p FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"
_WALKS = f"WITH {_TRADE}, w1 AS (SELECT s AS a, d AS b, [s, d] AS path, 1 AS depth, CAST(p AS DOUBLE) AS score FROM t WHERE s <> d), w2 AS (SELECT a, d AS b, list_append(path, d) AS path, 2 AS depth, CAST(score + p AS DOUBLE) AS score FROM w1 JOIN t ON s = b WHERE NOT list_contains(path, d)), w3 AS (SELECT a, d AS b, list_append(path, d) AS path, 3 AS depth, CAST(score + p AS DOUBLE) AS score FROM w2 JOIN t ON s = b WHERE NOT list_contains(path, d)), w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3)"


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf).catalog.edges["TRADES"].ends().select(F.col("_src").cast("bigint"), F.col("_dst").cast("bigint"), "pheromone")


@built(f"{_WALKS} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, count(*) AS paths FROM w GROUP BY ALL")
def path_count3(spark: SparkSession, sf: str) -> DataFrame:
    return paths.path_counts(None, _trades(spark, sf)).select(F.col("_src").alias("a"), F.col("_dst").alias("b"), "paths")


_CHAIN = "WITH RECURSIVE e AS (SELECT * FROM (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d, 0.125 + (o_orderkey % 64) / 8.0 AS p FROM orders) WHERE d IS NOT NULL), w AS (SELECT s AS a, d AS b, 1 AS depth, CAST(p AS DOUBLE) AS score, [s, d] AS path FROM e WHERE s NOT IN (SELECT d FROM e) UNION ALL SELECT w.a, e.d, w.depth + 1, CAST(w.score + e.p AS DOUBLE), list_append(w.path, e.d) FROM w JOIN e ON w.b = e.s)"


def _firsts(edges: DataFrame) -> DataFrame:
    return edges.select("_src").join(edges.select(F.col("_dst").alias("_src")), "_src", "left_anti").distinct()


@built(f"{_CHAIN} SELECT a, b, CAST(depth AS INT) AS depth, score FROM w")
def strongest_path(spark: SparkSession, sf: str) -> DataFrame:
    edges = _next(spark, sf)
    return paths.strongest_paths(_firsts(edges), edges).select(F.col("_src").alias("a"), F.col("_dst").alias("b"), "depth", "score")


@built(f"{_CHAIN} SELECT a, b, CAST(depth AS INT) AS depth, array_to_string(path, ' ') AS path FROM w")
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    edges = _next(spark, sf)
    return paths.shortest_paths(_firsts(edges), edges).select(F.col("_src").alias("a"), F.col("_dst").alias("b"), "depth", F.array_join("path", " ").alias("path"))


@built(f"WITH RECURSIVE {_TRADE}, e AS (SELECT s, d FROM t WHERE s <> d AND p > 7), w AS (SELECT s AS a, d AS b, 1 AS depth, [s, d] AS path FROM e UNION ALL SELECT a, d, depth + 1, list_append(path, d) FROM w JOIN e ON s = b WHERE NOT list_contains(path, d) AND depth < 4) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(depth AS INT) AS depth, array_to_string(path, ' ') AS path FROM w QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY depth, path) = 1")
def shortest_path_dense(spark: SparkSession, sf: str) -> DataFrame:
    edges = _trades(spark, sf).where("pheromone > 7")
    return paths.shortest_paths(edges.select("_src"), edges, 4).select(F.col("_src").alias("a"), F.col("_dst").alias("b"), "depth", F.array_join("path", " ").alias("path")).where("a <> b")


@built(f"WITH RECURSIVE {_TRADE}, e AS (SELECT s, d FROM t WHERE s <> d AND p > 7.5), w AS (SELECT s AS a, d AS b, 1 AS depth, [s, d] AS path FROM e UNION ALL SELECT a, d, depth + 1, list_append(path, d) FROM w JOIN e ON s = b WHERE NOT list_contains(path, d) AND depth < 4) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, array_to_string(path, ' ') AS path FROM w")
def all_paths(spark: SparkSession, sf: str) -> DataFrame:
    edges = _trades(spark, sf).where("pheromone > 7.5")
    return paths.walks(None, edges, 4).select(F.col("_src").alias("a"), F.col("_dst").alias("b"), F.array_join("path", " ").alias("path"))


_RANKS = ", ".join(f"r{k + 1} AS (SELECT v, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM r{k} WHERE v NOT IN (SELECT s FROM e)) / (SELECT count(*) FROM n) + 0.85::DOUBLE * coalesce((SELECT sum(r / o) FROM e JOIN r{k} ON r{k}.v = e.s JOIN o USING (s) WHERE e.d = n.v), 0) AS r FROM n)" for k in range(5))


@built(f"WITH {_TRADE}, e AS (SELECT CAST(s AS BIGINT) AS s, CAST(d AS BIGINT) AS d FROM t WHERE p > 6), n AS (SELECT s AS v FROM e UNION SELECT d FROM e), o AS (SELECT s, count(*) AS o FROM e GROUP BY s), r0 AS (SELECT v, 1::DOUBLE / (SELECT count(*) FROM n) AS r FROM n), {_RANKS} SELECT v AS node, round(r, 12) AS rank FROM r5")
def page_rank(spark: SparkSession, sf: str) -> DataFrame:
    return paths.page_rank(_trades(spark, sf).where("pheromone > 6"), 5).select("node", F.round("rank", 12).alias("rank"))


@built("SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS community FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return paths.communities(_next(spark, sf))


@built("""WITH RECURSIVE e AS (SELECT * FROM (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) WHERE d IS NOT NULL),
f AS (SELECT min(s) AS v FROM e), w AS (SELECT d AS k, 1 AS depth FROM e, f WHERE s = v UNION ALL SELECT d, depth + 1 FROM w JOIN e ON s = k WHERE depth < 5) SELECT k AS o_orderkey, CAST(min(depth) AS INT) AS depth FROM w GROUP BY k""")
def traverse_api(spark: SparkSession, sf: str) -> DataFrame:
    db = load(spark, sf)
    first = db.catalog.edges["NEXT"].ends().agg(F.min("_src")).first()[0]
    return db.session().traverse("Orders", first, "NEXT", 5)


@built("SELECT node, count(*) AS degree FROM (SELECT DISTINCT l_orderkey AS node, l_partkey AS o, 'c' AS t FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 's' FROM lineitem) GROUP BY node")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    edges = load(spark, sf).catalog.edges
    both = [edges[k].ends().select("_src", "_dst").withColumn("_type", F.lit(k)) for k in ("CONTAINS", "SHIPPED_BY")]
    return stats.degrees(both[0].union(both[1]))


@built("SELECT node, count(*) AS degree FROM (SELECT DISTINCT o_custkey AS node, o_orderkey AS o, 'p' AS t, 'o' AS w FROM orders UNION ALL SELECT DISTINCT user_id, event_id, 't', 'o' FROM events UNION ALL SELECT DISTINCT o_orderkey, o_custkey, 'p', 'i' FROM orders UNION ALL SELECT DISTINCT event_id, user_id, 't', 'i' FROM events) GROUP BY node")
def degree_both(spark: SparkSession, sf: str) -> DataFrame:
    edges = load(spark, sf).catalog.edges
    both = [edges[k].ends().select("_src", "_dst").withColumn("_type", F.lit(k)) for k in ("PLACED", "TRIGGERED")]
    return stats.degrees(both[0].union(both[1]), "both", hubs=True)


@built("SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem")
def neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return stats.neighbours(load(spark, sf).catalog.edges["CONTAINS"].ends()).select(F.col("_src").alias("a"), F.col("_dst").alias("b"))


@built("SELECT l_orderkey AS a, l_partkey AS b, l_quantity AS q FROM lineitem WHERE l_orderkey = 1 AND l_partkey = (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = 1)")
def edges_between(spark: SparkSession, sf: str) -> DataFrame:
    edges = load(spark, sf).catalog.edges["CONTAINS"].ends()
    target = edges.where("_src = 1").agg(F.min("_dst")).first()[0]
    return stats.between(edges, 1, target if target is not None else -1).select(F.col("_src").alias("a"), F.col("_dst").alias("b"), F.col("l_quantity").alias("q"))


# SQL and Cypher
text("sql_where_and", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_totalprice <= 200000", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_totalprice <= 200000")
text("sql_join", "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000 ORDER BY o.o_orderkey", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000 ORDER BY o_orderkey")
text("sql_left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
text("sql_semi_join", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
text("sql_anti_join", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
text("sql_three_way", "SELECT n.n_name, SUM(l.l_quantity) AS q FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY n.n_name", "SELECT n_name, sum(l_quantity) AS q FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey GROUP BY n_name")
text("sql_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
text("sql_intersect", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey AS k FROM part WHERE p_size < 10", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey AS k FROM part WHERE p_size < 10")
text("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 350000", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 350000")
text("cypher_chain", "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[e:CONTAINS]->(p:Part) WHERE p.p_size > 40 AND e.l_quantity > 40 RETURN c.c_custkey, o.o_orderkey, p.p_partkey", """SELECT c_custkey AS "c.c_custkey", o_orderkey AS "o.o_orderkey", p_partkey AS "p.p_partkey" FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 40 AND l_quantity > 40""")
text("cypher_props", "MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:LIVES_IN]->(n:Nation {n_regionkey: 3}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
text("cypher_incoming_agg", "MATCH (r:Region)<-[:PART_OF]-(n:Nation)<-[:LIVES_IN]-(c:Customer) RETURN r.r_name AS region, COUNT(*) AS customers", "SELECT r_name AS region, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")


# joins beyond equality, windows
@built("SELECT o_orderkey, event_id FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders) o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts")
def join_as_of(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    e = table(spark, sf, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return joins.as_of(o, e, "user_id", "ts", ["event_id"]).select("o_orderkey", "event_id")


@built("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 50")
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    ranges = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return joins.in_range(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ranges, "low", "high", 100.0).select("p_partkey", "s_suppkey")


text("window_functions", "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders",
    "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS place, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS near, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
text("window_over_groups", "FROM Orders SELECT o_custkey, COUNT(*) AS n, DENSE_RANK() OVER (PARTITION BY COUNT(*) ORDER BY MAX(o_totalprice) DESC) AS place GROUP BY o_custkey",
    "SELECT o_custkey, count(*) AS n, CAST(dense_rank() OVER (PARTITION BY count(*) ORDER BY max(o_totalprice) DESC) AS INT) AS place FROM orders GROUP BY o_custkey")
text("window_values", "FROM Customer SELECT c_custkey, MAX(c_acctbal) OVER (PARTITION BY c_nationkey) AS whole, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS part, LEAD(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS later",
    "SELECT c_custkey, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS whole, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS part, lead(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS later FROM customer")


@built("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.tumbling(table(spark, sf, "events"), "1 hour").drop("total")


@built("WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS events FROM g GROUP BY user_id, k")
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.sessions(table(spark, sf, "events"), "30 minutes")


# changes
def _changed(spark: SparkSession, sf: str, statement: str, show: str) -> DataFrame:
    s = load(spark, sf).session()
    s.execute(statement)
    return s.execute(show)


@built("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 2")
def insert_select(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, "INSERT INTO Nation VALUES ({n_nationkey: 100, n_name: 'ATLANTIS', n_regionkey: 2})", "FROM Nation SELECT *")


@built("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_size < 10 THEN 'small' ELSE p_type END AS p_type FROM part")
def update_where(spark: SparkSession, sf: str) -> DataFrame:
    s: n.Update = parse("UPDATE Part SET p_size = p_size + 100, p_type = 'small' WHERE p_size < 10")
    return changes.updated(load(spark, sf).catalog.collection("Part"), s).select("p_partkey", "p_size", "p_type")


@built("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_totalprice < 200000, false)")
def delete_where(spark: SparkSession, sf: str) -> DataFrame:
    s: n.Delete = parse("DELETE FROM Orders WHERE o_orderstatus = 'F' AND o_totalprice < 200000")
    return changes.remaining(load(spark, sf).catalog.collection("Orders"), s).select("o_orderkey")


@built("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal >= 0")
def delete_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, "DELETE FROM Customer WHERE c_acctbal < 0", "FROM Customer c TRAVERSE -[:PLACED]-> o SELECT c.c_custkey, o.o_orderkey")


@built("SELECT CAST(1 AS BIGINT) AS c_custkey, o_orderkey FROM orders WHERE o_custkey = 1 UNION ALL SELECT 1, 7")
def create_edge(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf, "CREATE (1)-[:PLACED]->(7)", "FROM Customer c TRAVERSE -[:PLACED]-> o WHERE c.c_custkey = 1 SELECT c.c_custkey, o.o_orderkey")


@built("SELECT 25 AS committed, 26 AS inside, 25 AS outside")
def transaction_rollback(spark: SparkSession, sf: str) -> DataFrame:
    db = load(spark, sf)
    a, b = db.session(), db.session()
    a.execute("BEGIN TRANSACTION")
    a.execute("INSERT INTO Nation VALUES ({n_nationkey: 100, n_name: 'ATLANTIS', n_regionkey: 2})")
    inside, outside = (x.execute("FROM Nation SELECT COUNT(*) AS n").first()[0] for x in (a, b))
    a.execute("ROLLBACK")
    return spark.createDataFrame([(a.execute("FROM Nation SELECT COUNT(*) AS n").first()[0], inside, outside)], "committed int, inside int, outside int")


# indexes, constraints
@built("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 11")
def index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.lookup(table(spark, sf, "orders"), "o_custkey", 11).select("o_orderkey", "o_totalprice")


@built("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def index_range(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.between(table(spark, sf, "part"), "p_size", 10, 20).select("p_partkey", "p_size")


@built("SELECT p_partkey FROM part WHERE p_size > 40 OR p_size < 5")
def index_open_ranges(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return indexes.greater(part, "p_size", 40).union(indexes.less(part, "p_size", 5)).select("p_partkey")


@built("SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.violations(table(spark, sf, "lineitem"), "l_orderkey")


@built("SELECT count(DISTINCT o_custkey) AS keys, count(o_custkey) AS entries FROM orders")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.stats(table(spark, sf, "orders"), "o_custkey")


@built("SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_acctbal:check,c_mktsegment:check' WHEN c_acctbal < 0 THEN 'c_acctbal:check' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment:check' ELSE '' END AS errors FROM customer")
def schema_errors(spark: SparkSession, sf: str) -> DataFrame:
    f = constraints.Field
    schema = constraints.Schema((f("c_custkey", "bigint", primary=True), f("c_name", "string", required=True), f("c_nationkey", "bigint"), f("c_acctbal", "double", check="c_acctbal >= 0"), f("c_mktsegment", "string", check="c_mktsegment IN ('BUILDING', 'MACHINERY')")))
    return schema.validated(table(spark, sf, "customer")).select("c_custkey", F.array_join(F.transform("errors", lambda x: F.concat(x["field"], F.lit(":"), x["problem"])), ",").alias("errors"))


# versions, logs (a line of an order is a version of it)
_VERSIONS = "v AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS version, l_partkey % 100 AS created_by, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 100 + 10 END AS deleted_by FROM lineitem)"


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    made = F.col("l_partkey") % 100
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.row_number().over(w).cast("bigint").alias("version"), made.alias("created_by"), F.when(F.col("l_suppkey") % 3 == 0, made + 10).alias("deleted_by"))


@built(f"WITH {_VERSIONS} SELECT id, version, created_by, deleted_by FROM v WHERE created_by < 50 AND (deleted_by IS NULL OR deleted_by > 50) QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def mvcc_visible(spark: SparkSession, sf: str) -> DataFrame:
    return versions.visible(_versions(spark, sf), 50)


@built(f"WITH {_VERSIONS}, k AS (SELECT *, created_by >= 50 OR deleted_by IS NULL OR deleted_by >= 50 AS keep FROM v) SELECT id, version, created_by, deleted_by FROM k QUALIFY keep OR row_number() OVER (PARTITION BY id ORDER BY version) = 1")
def mvcc_gc(spark: SparkSession, sf: str) -> DataFrame:
    return versions.collected(_versions(spark, sf), 50)


@built(f"WITH {_VERSIONS} SELECT id, version, created_by, deleted_by FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def mvcc_latest(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest(_versions(spark, sf))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "begin").when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "error", "rollback").otherwise("update")
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("txn"), kind.alias("kind"))


_LOG = "l AS (SELECT event_id AS pos, user_id AS txn, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'rollback' ELSE 'update' END AS kind FROM events)"


@built(f"WITH {_LOG} SELECT txn, CASE arg_max(kind, pos) FILTER (kind IN ('commit', 'rollback')) WHEN 'commit' THEN 'committed' WHEN 'rollback' THEN 'aborted' ELSE 'active' END AS outcome, count(*) FILTER (kind = 'update') AS changes FROM l GROUP BY txn")
def wal_classify(spark: SparkSession, sf: str) -> DataFrame:
    return versions.outcomes(_log(spark, sf))


@built(f"WITH {_LOG}, o AS (SELECT txn FROM l GROUP BY txn HAVING arg_max(kind, pos) FILTER (kind IN ('commit', 'rollback')) = 'commit') SELECT pos, txn, kind FROM l SEMI JOIN o USING (txn) WHERE kind = 'update'")
def wal_redo(spark: SparkSession, sf: str) -> DataFrame:
    return versions.redo(_log(spark, sf)).select("pos", "txn", "kind")


@built("SELECT event_id AS seq, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def repl_batch(spark: SparkSession, sf: str) -> DataFrame:
    return versions.entries_since(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type"), 500, 100)


@built("SELECT event_type AS replica, max(event_id) AS seq, (SELECT max(o_orderkey) FROM orders) - max(event_id) AS lag FROM events WHERE event_id < 900 GROUP BY 1")
def repl_lag(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"))
    applied = table(spark, sf, "events").where("event_id < 900").select(F.col("event_id").alias("seq"), F.col("event_type").alias("replica"))
    return versions.lag(log, applied)


@built("WITH c AS (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM c) UNION ALL SELECT user_id, value FROM c WHERE t <> 'error'")
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("action"), F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"))
    return versions.applied_changes(base, e, "c_custkey")


# strength of edges
_NEXT = "e AS (SELECT * FROM (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d, CAST(0.125 + (o_orderkey % 64) / 8.0 AS DOUBLE) AS p FROM orders) WHERE d IS NOT NULL)"


def _next(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf).catalog.edges["NEXT"].ends()


@built(f"WITH {_NEXT} SELECT s AS _src, d AS _dst, greatest(p * CAST(0.95 AS DOUBLE), CAST(0.1 AS DOUBLE)) AS pheromone FROM e")
def pheromone_evaporate(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.evaporated(_next(spark, sf))


@built(f"WITH {_NEXT} SELECT s AS _src, d AS _dst, least(greatest(p + CAST(3 AS DOUBLE), CAST(0.1 AS DOUBLE)), CAST(10 AS DOUBLE)) AS pheromone FROM e")
def pheromone_reinforce(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.reinforced(_next(spark, sf), F.lit(3.0))


@built(f"WITH {_NEXT} SELECT s AS _src, d AS _dst, round(1 / p * (1 + ln(CAST(s AS DOUBLE)) / 10), 9) AS by_latency, round(1 / p * (1 + ln(CAST(s % 5 AS DOUBLE) + 1) / 10), 9) AS by_cost FROM e WHERE s > 0")
def edge_weight(spark: SparkSession, sf: str) -> DataFrame:
    p, x = F.col("pheromone"), F.col("_src")
    return _next(spark, sf).where("_src > 0").select("_src", "_dst", F.round(pheromone.weight_by_latency(p, x), 9).alias("by_latency"), F.round(pheromone.weight_by_cost(p, x % 5), 9).alias("by_cost"))


@built(f"WITH {_NEXT} SELECT s AS _src, d AS _dst, p AS pheromone FROM e WHERE p < 0.5")
def stale_edges(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.stale(_next(spark, sf))


_FOLD = "SELECT c_custkey AS edge, round(least(CAST(10 AS DOUBLE), CAST(1 AS DOUBLE) + coalesce(sum({gain}), 0)), 9) AS pheromone, count(v) AS traversals, round(coalesce(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(v ORDER BY event_id) FILTER (v IS NOT NULL)), lambda a, x: CASE WHEN a = 0 THEN x ELSE {mean} END), 0), 6) AS latency FROM customer LEFT JOIN (SELECT user_id, event_id, CAST({value} AS DOUBLE) AS v FROM events) ON user_id = c_custkey GROUP BY c_custkey"
_MEAN = "CAST(0.3 AS DOUBLE) * x + CAST(0.7 AS DOUBLE) * a"


def _marked(spark: SparkSession, sf: str, latency: Column, unit: str) -> DataFrame:
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("edge"), F.lit(1.0).alias("pheromone"), F.lit(0).alias("traversals"), F.lit(0.0).alias("latency"))
    log = table(spark, sf, "events").select(F.col("user_id").alias("edge"), F.col("event_id").alias("at"), latency.alias("latency"))
    return pheromone.traversals(e, log, unit).select("edge", F.round("pheromone", 9).alias("pheromone"), "traversals", F.round("latency", 6).alias("latency"))


@built(_FOLD.format(gain="1 / (1 + v / 1e6)", mean=f"floor({_MEAN})", value="floor(abs(value) * 100000)"))
def mark_traversed(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf, F.floor(F.abs("value") * 100000), "nanos")


@built(_FOLD.format(gain="CASE WHEN v > 0 THEN 1 / ln(v + 2) ELSE 0 END", mean=_MEAN, value="event_id % 7"))
def mark_traversed_ms(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf, F.col("event_id") % 7, "millis")


#: Of a customer's first four orders: the first leads weakly to the second and third, these strongly to each other, and the third weakly to the fourth.
_KNOT = "k AS (SELECT o_custkey AS c, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS o FROM orders GROUP BY o_custkey HAVING count(*) >= 4), n AS (SELECT unnest([{'s': o[1], 'd': o[2], 'p': 0.05}, {'s': o[1], 'd': o[3], 'p': 0.1}, {'s': o[2], 'd': o[3], 'p': 5.0}, {'s': o[3], 'd': o[2], 'p': 8.0}, {'s': o[3], 'd': o[4], 'p': 0.1}], recursive := true) FROM k)"


def _knots(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o")).where("size(o) >= 4")
    ends = ((0, 1, 0.05), (0, 2, 0.1), (1, 2, 5.0), (2, 1, 8.0), (2, 3, 0.1))
    made = F.array(*[F.struct(F.col("o")[a]["o_orderkey"].alias("_src"), F.col("o")[b]["o_orderkey"].alias("_dst"), F.lit(p).alias("pheromone")) for a, b, p in ends])
    e = o.select(F.explode(made).alias("e")).select("e.*")
    return e.withColumn("flow", F.col("_src") % 5).withColumn("latency", (F.col("_dst") % 9) * 10.0).withColumn("idle", F.when(F.col("pheromone") > 1, 5).otherwise(100))


@built(f"WITH {_KNOT}, r AS (SELECT s, d, CAST(CASE WHEN p > 1 THEN least(10, p + CAST(0.1 AS DOUBLE) * ln(s % 5 + 1) / (1 + (d % 9) * 10.0 / 100)) ELSE greatest(p * 0.95, 0.1) END AS DOUBLE) AS p FROM n) SELECT s AS _src, d AS _dst, round(p, 9) AS pheromone FROM r")
def network_refresh(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.refreshed(_knots(spark, sf)).select("_src", "_dst", F.round("pheromone", 9).alias("pheromone"))


# of two weak edges from the first order the one to the smaller key is looked at first, and goes, as the other is still there; that one then stays
@built(f"WITH {_KNOT}, g AS (SELECT o[1] AS s, least(o[2], o[3]) AS d FROM k) SELECT s AS _src, d AS _dst FROM n WHERE (s, d) NOT IN (SELECT (s, d) FROM g)")
def network_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.pruned(pheromone.refreshed(_knots(spark, sf))).select("_src", "_dst")


# the edge from the third order to the second is important and has no second path: the middle is the smallest of what it leads to or what leads to its end
_NEAR = "o[2] > o[3] AND o[1] < o[4]"
_ADDED = f"SELECT CASE WHEN {_NEAR} THEN o[3] ELSE o[4] END AS _src, CASE WHEN {_NEAR} THEN o[1] ELSE o[2] END AS _dst, CAST(0.2 AS DOUBLE) AS pheromone FROM k"


@built(f"WITH {_KNOT} {_ADDED}")
def network_backups(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.backups(pheromone.pruned(_knots(spark, sf)))


@built(f"WITH {_KNOT}, g AS (SELECT o[1] AS s, least(o[2], o[3]) AS d FROM k), r AS (SELECT s, d, CAST(CASE WHEN p > 1 THEN least(10, p + CAST(0.1 AS DOUBLE) * ln(s % 5 + 1) / (1 + (d % 9) * 10.0 / 100)) ELSE greatest(p * 0.95, 0.1) END AS DOUBLE) AS p FROM n) SELECT s AS _src, d AS _dst, round(p, 9) AS pheromone FROM r WHERE (s, d) NOT IN (SELECT (s, d) FROM g) UNION ALL {_ADDED}")
def network_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.reconfigured(_knots(spark, sf)).select("_src", "_dst", F.round("pheromone", 9).alias("pheromone"))


@built(f"{_WALKS}, c AS (SELECT a, b, count(*) AS paths FROM w GROUP BY ALL), j AS (SELECT t.*, coalesce(paths, 0) AS paths FROM t LEFT JOIN c ON a = s AND b = d) SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT s FROM t UNION SELECT d FROM t)) AS nodes, CAST(avg(CAST(p AS DOUBLE)) AS DOUBLE) AS avg_strength, avg(CASE WHEN paths > 1 THEN 1.0 ELSE 0.0 END) AS redundancy, CASE WHEN avg(CASE WHEN paths > 1 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'healthy' ELSE 'degraded' END AS status FROM j")
def network_health(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.health(_trades(spark, sf))


@built("SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))) AS nodes, CAST(0 AS DOUBLE) AS redundancy, 'degraded' AS status FROM (SELECT lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) WHERE d IS NOT NULL")
def network_health_chains(spark: SparkSession, sf: str) -> DataFrame:
    return pheromone.health(_next(spark, sf)).drop("avg_strength")


# figures, placement
_ROWS = " + ".join(f"(SELECT count(*) FROM {t})" for t in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events"))
_EDGES = "(SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM events) + (SELECT count(*) FROM e) + (SELECT count(*) FROM t)"


@built(f"WITH {_NEXT}, {_TRADE} SELECT {_ROWS} AS entities, {_EDGES} AS edges, CAST(8 AS BIGINT) AS collections, round(((SELECT sum(p) FROM e) + (SELECT sum(p) FROM t) + ({_EDGES}) - (SELECT count(*) FROM e) - (SELECT count(*) FROM t)) / ({_EDGES}), 9) AS avg_pheromone")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.graph_stats(load(spark, sf).catalog).withColumn("avg_pheromone", F.round("avg_pheromone", 9))


@built("SELECT count(*) AS rows, CAST(4.0 AS DOUBLE) AS avg_properties, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)) / count(*) AS avg_degree FROM customer")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf).catalog
    return stats.collection_stats(c, "Customer", c.edges["PLACED"])


_COLUMNS = {"customer": "c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "lineitem": "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "part": "p_name p_brand p_type p_size p_retailprice", "supplier": "s_name s_nationkey s_acctbal", "nation": "n_name n_regionkey", "region": "r_name", "events": "ts user_id event_type value props"}


@built(f"WITH {_NEXT}, {_TRADE} SELECT {_ROWS} AS entities, {' + '.join(f'(SELECT {chr(32).join(('count(' + c + ') +') for c in cs.split())} 0 FROM {t})' for t, cs in _COLUMNS.items())} AS properties, CAST(8 AS BIGINT) AS collections, {_EDGES} AS edges")
def dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dashboard(load(spark, sf).catalog)


@built("SELECT c_mktsegment, count(*) AS rich FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def view_query(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf).session()
    s.view("Rich", "FROM Customer WHERE c_acctbal > 5000 SELECT *", "c_custkey")
    return s.execute("FROM Rich SELECT c_mktsegment, COUNT(*) AS rich GROUP BY c_mktsegment")


@built("SELECT n_name AS name, n_regionkey AS k FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def insert_from(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf).session()
    s.view("Places", "FROM Nation SELECT n_name AS name, n_regionkey AS k")
    s.insert_from("Places", s.execute("FROM Region SELECT r_name AS name, r_regionkey AS k"))
    return s.execute("FROM Places SELECT name, k")


@built("WITH t AS (SELECT user_id, count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS successes, min(event_id) % 200 AS ms, CAST(0.125 + (user_id % 64) / 8.0 AS DOUBLE) * CAST(0.95 AS DOUBLE) AS p FROM events GROUP BY user_id) SELECT user_id, runs, successes FROM t WHERE p >= 0.2 AND user_id % 80 <= 60 ORDER BY p * (successes / runs) / (1 + ms / 100.0) DESC, user_id LIMIT 50")
def trails_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("successes"), (F.min("event_id") % 200).alias("ms"))
    t = t.withColumn("pheromone", F.lit(0.125) + F.pmod("user_id", F.lit(64)) / 8.0).withColumn("idle", F.col("user_id") % 80)
    return pheromone.trails_kept(t, 50).select("user_id", "runs", "successes")


def _ring(nodes: str) -> str:
    """SQL of the map of shards: 150 places a node, the next one for each shard's own place."""
    names = ", ".join(f"'{x}'" for x in nodes)
    return f"v AS (SELECT n, substr(md5(n || '#' || k), 1, 16) AS p FROM (SELECT unnest([{names}]) AS n), (SELECT unnest(range(150)) AS k)), s AS (SELECT unnest(range(1024)) AS shard), h AS (SELECT shard, substr(md5('shard-' || shard), 1, 16) AS p FROM s), m AS (SELECT shard, coalesce((SELECT arg_min(v.n, v.p) FROM v WHERE v.p >= h.p), (SELECT arg_min(v.n, v.p) FROM v)) AS node FROM h)"


@built(f"WITH {_ring('abc')}, c AS (SELECT ('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 1024 AS shard FROM customer) SELECT node, count(*) AS rows FROM c JOIN m USING (shard) GROUP BY node")
def shard_placement(spark: SparkSession, sf: str) -> DataFrame:
    placed = shards.shard_map(spark, shards.Ring(["a", "b", "c"]))
    return shards.placement(table(spark, sf, "customer"), "c_custkey", placed).groupBy("node").agg(F.count(F.lit(1)).alias("rows"))


@built("SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 1024 AS INT) AS shard FROM orders")
def shard_of_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", shards.shard_of(F.col("o_orderkey")).alias("shard"))


@built(f"WITH a AS (WITH {_ring('abc')} SELECT * FROM m), b AS (WITH {_ring('abcd')} SELECT * FROM m) SELECT CAST(shard AS INT) AS shard, a.node AS source, b.node AS target FROM a JOIN b USING (shard) WHERE a.node <> b.node")
def shard_moves(spark: SparkSession, sf: str) -> DataFrame:
    return shards.moves(shards.shard_map(spark, shards.Ring(["a", "b", "c"])), shards.shard_map(spark, shards.Ring(["a", "b", "c", "d"])))


@built(f"WITH {_ring('abc')} SELECT node, count(*) AS primaries, 1024 - count(*) AS replicas FROM m GROUP BY node")
def shard_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Three copies on three nodes: every node holds a copy of every shard."""
    return shards.node_stats(shards.shard_map(spark, shards.Ring(["a", "b", "c"])))


from fernwork import interface_queries  # noqa: E402,F401  registers the queries of statements, sources and sinks
