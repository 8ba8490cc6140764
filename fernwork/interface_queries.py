"""Queries of the interface: statements, schemas, transactions, logs, sources and sinks, streams, and the rest of the languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwork.functions.expressions import QueryError
from fernwork.operators import changes, constraints, indexes, pheromone, shards, stats, versions
from fernwork.registry import built, text
from fernwork.session import Database, Session, TransactionError, query
from fernwork.sources import backup, log
from fernwork.sources.scratch import new_path
from fernwork.sources.tables import load, read_csv, table, write_csv
from fernwork.streaming import feeds


def _session(spark: SparkSession, sf: str, *statements: str) -> Session:
    s = load(spark, sf).session()
    for x in statements:
        s.execute(x)
    return s


def _refused(s: Session, statement: str) -> bool:
    """Whether a statement is refused by a rule of the data."""
    try:
        s.execute(statement)
    except QueryError:
        return True
    return False


def _holes(spark: SparkSession, sf: str) -> Session:
    """A collection with nulls in two columns, strings that are digits, and a boolean."""
    s = _session(spark, sf)
    s.view("Holes", "FROM Orders SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, SUBSTRING(o_orderpriority, 1, 1) AS digit, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '3' END AS mixed, o_orderkey % 2 = 0 AS even", "id")
    return s


_HOLES = "h AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, substr(o_orderpriority, 1, 1) AS digit, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '3' END AS mixed, o_orderkey % 2 = 0 AS even FROM orders)"


def held(name: str, statement: str, sql: str, lang: str | None = None) -> None:
    """A query over the collection with nulls."""

    def f(spark: SparkSession, sf: str) -> DataFrame:
        return _holes(spark, sf).execute(statement, lang)

    f.__name__ = name
    built(f"WITH {_HOLES} {sql}")(f)


# comparisons with nulls and between types
held("filter_null_safe", "FROM Holes WHERE status != 'O' AND NOT price >= 200000 SELECT id, status", "SELECT id, status FROM h WHERE status IS DISTINCT FROM 'O' AND NOT coalesce(price >= 200000, false)")
held("filter_null_equal", "FROM Holes WHERE status = NULL AND NOT price = NULL SELECT id", "SELECT id FROM h WHERE status IS NULL AND price IS NOT NULL")
held("filter_null_sql", "SELECT id FROM Holes WHERE status <> 'O' AND NOT price >= 200000", "SELECT id FROM h WHERE status <> 'O' AND NOT price >= 200000", "sql")
held("filter_bare_boolean", "FROM Holes WHERE even AND NOT status = 'O' SELECT id", "SELECT id FROM h WHERE even AND status IS DISTINCT FROM 'O'")
held("compare_mixed_types", "FROM Holes WHERE digit = 1 OR digit > 1 OR price = 'x' OR even > FALSE SELECT id", "SELECT id FROM h WHERE false")
held("compare_mixed_negated", "FROM Holes WHERE digit != 1 AND NOT digit > 1 AND NOT price <= 'x' AND price != 'x' SELECT id", "SELECT id FROM h")
held("compare_mixed_null", "FROM Holes WHERE status = price SELECT id", "SELECT id FROM h WHERE status IS NULL AND price IS NULL")
held("compare_number_kinds", "FROM Holes WHERE price > id AND id = 7.0 SELECT id", "SELECT id FROM h WHERE price > id AND id = 7")
held("compare_coerced_sql", "SELECT id FROM Holes WHERE digit > 2 AND mixed = 3", "SELECT id FROM h WHERE CAST(digit AS INT) > 2 AND TRY_CAST(mixed AS DOUBLE) = 3", "sql")
held("compare_text_sql", "SELECT id FROM Holes WHERE id = '12'", "SELECT id FROM h WHERE id = 12", "sql")
held("compare_strict_cypher", "MATCH (h:Holes) WHERE h.digit = 1 OR h.digit > 1 RETURN h.id AS id", "SELECT id FROM h WHERE false")
held("agg_nulls", "FROM Holes SELECT status, COUNT(price) AS n, SUM(price) AS s, MIN(price) AS lo GROUP BY status", "SELECT status, count(*) AS n, coalesce(sum(price), 0) AS s, min(price) AS lo FROM h GROUP BY status")
held("sort_nulls_last", "FROM Holes SELECT id, price ORDER BY price DESC, id LIMIT 20000", "SELECT id, price FROM h ORDER BY price DESC NULLS LAST, id LIMIT 20000")
text("keyword_names", "FROM Nation SELECT n_nationkey AS count, n_name AS order", 'SELECT n_nationkey AS "count", n_name AS "order" FROM nation')
text("path_exact_hops", "FROM Orders x TRAVERSE -[p:NEXT*2]-> y SELECT x.o_orderkey AS a, y.o_orderkey AS b", "SELECT * FROM (SELECT o_orderkey AS a, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL")
text("project_more_functions", "FROM Part SELECT p_partkey AS k, ABS(p_size - 25) AS a, UPPER(p_name) AS u, CONCAT(p_brand, '/', p_type) AS c, SUBSTRING(p_brand, 7) AS b, REPLACE(p_type, 'BRASS', '-') AS r, COALESCE(p_type, '?') AS t, GREATEST(p_size, 20) AS g, LEAST(p_size, 20) AS l, NULLIF(p_size, 10) AS z, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS e, STARTSWITH(p_type, 'S') AS s, CONTAINS(p_type, 'TIN') AS i, TRIM(p_brand) AS m, SIGN(p_size - 25) AS n",
     "SELECT p_partkey AS k, abs(p_size - 25) AS a, upper(p_name) AS u, p_brand || '/' || p_type AS c, substr(p_brand, 7) AS b, replace(p_type, 'BRASS', '-') AS r, coalesce(p_type, '?') AS t, greatest(p_size, 20) AS g, least(p_size, 20) AS l, nullif(p_size, 10) AS z, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS e, starts_with(p_type, 'S') AS s, contains(p_type, 'TIN') AS i, trim(p_brand) AS m, CAST(sign(p_size - 25) AS DOUBLE) AS n FROM part")


@built("SELECT strftime(ts, '%Y-%m-%d') AS d, event_type AS e, count(*) AS n FROM events GROUP BY ALL")
def agg_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return _session(spark, sf).execute("FROM Event SELECT DATE(ts) AS d, event_type AS e, COUNT(*) AS n GROUP BY DATE(ts), event_type").select(F.col("d").cast("string").alias("d"), "e", "n")


# the rest of SQL
text("sql_right_join", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 400000")
text("sql_full_join", "SELECT p.p_partkey, s.s_suppkey FROM part p FULL OUTER JOIN supplier s ON p.p_partkey = s.s_suppkey * 3", "SELECT p_partkey, s_suppkey FROM part FULL JOIN supplier ON p_partkey = s_suppkey * 3")
text("sql_cross_join", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", "SELECT r_name, n_name FROM region CROSS JOIN nation")
text("sql_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
text("sql_theta_join", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_nationkey > r.r_regionkey * 4", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey > r_regionkey * 4")
text("sql_asof_join", "SELECT o.o_orderkey, e.ts AS latest FROM orders o ASOF LEFT JOIN event e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts", "SELECT o_orderkey, (SELECT max(ts) FROM events WHERE user_id = o_custkey AND ts <= o_orderdate) AS latest FROM orders")
text("sql_limit", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7")
text("sql_intersect_all", "SELECT l_partkey AS k FROM lineitem INTERSECT ALL SELECT l_suppkey AS k FROM lineitem", "SELECT l_partkey AS k FROM lineitem INTERSECT ALL SELECT l_suppkey AS k FROM lineitem")
text("sql_except_all", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey AS k FROM customer", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey AS k FROM customer")
text("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
text("sql_in_query", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_acctbal > 0", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_acctbal > 0")
text("sql_not_in_query", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05)", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05)")
text("sql_exists", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 50) AND NOT EXISTS (SELECT * FROM event e WHERE e.user_id = c.c_custkey AND e.event_type = 'error')", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50) AND NOT EXISTS (SELECT * FROM events WHERE user_id = c_custkey AND event_type = 'error')")
text("sql_scalar_query", "SELECT o_custkey, COUNT(*) AS n, (SELECT MAX(n_nationkey) FROM nation) AS m FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders) GROUP BY o_custkey HAVING COUNT(*) > (SELECT 2 + MIN(r_regionkey) FROM region)", "SELECT o_custkey, count(*) AS n, (SELECT max(n_nationkey) FROM nation) AS m FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY o_custkey HAVING count(*) > (SELECT 2 + min(r_regionkey) FROM region)")
text("sql_with", "WITH totals AS (SELECT o_custkey AS k, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), rich AS (SELECT k, t FROM totals WHERE t > 2000000) SELECT c.c_name, r.t FROM customer c JOIN rich r ON c.c_custkey = r.k", "WITH totals AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT c_name, t FROM customer JOIN totals ON c_custkey = k WHERE t > 2000000")
text("query_with", "WITH often AS (FROM Orders SELECT o_custkey AS k, COUNT(*) AS n GROUP BY o_custkey HAVING COUNT(*) > 12) FROM Customer c WHERE c.c_custkey IN (FROM often SELECT k) SELECT c.c_custkey, c.c_name", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
text("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
text("agg_spread", "FROM Part SELECT p_brand, ROUND(STDDEV(p_retailprice), 6) AS s, ROUND(VARIANCE(p_size), 6) AS v GROUP BY p_brand", "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS s, round(var_samp(p_size), 6) AS v FROM part GROUP BY 1")


@built("SELECT true AS near")
def agg_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate count lies within 10 % of the exact one."""
    df = _session(spark, sf).execute("FROM Lineitem SELECT APPROX_COUNT_DISTINCT(l_orderkey) AS a, COUNT(DISTINCT l_orderkey) AS n")
    return df.select((F.abs(F.col("a") - F.col("n")) <= F.col("n") * 0.1).alias("near"))


@built("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def cypher_entity(spark: SparkSession, sf: str) -> DataFrame:
    return _session(spark, sf).cypher("MATCH (n:Nation) RETURN n").select("n.*")


@built("SELECT unnest(['query', 'sql', 'cypher', 'query', 'sql', 'cypher', 'sql']) AS language, unnest([true, true, true, false, false, false, true]) AS planned")
def explain_statements(spark: SparkSession, sf: str) -> DataFrame:
    s = _session(spark, sf)
    texts = ["FROM Nation SELECT n_name", "SELECT n_name FROM nation", "MATCH (n:Nation) RETURN n.n_name", "DELETE FROM Nation", "CREATE TABLE t (id INT)", "CREATE (a:T {x: 1})", "WITH a AS (SELECT 1 AS x FROM nation) SELECT x FROM a"]
    found = [s.explain(x) for x in texts]
    return spark.createDataFrame([(x["language"], "Scan" in x["spark"]) for x in found], "language string, planned boolean")


@built("SELECT count(*) AS n FROM orders")
def one_shot(spark: SparkSession, sf: str) -> DataFrame:
    return query(load(spark, sf), "FROM Orders SELECT COUNT(*) AS n")


@built("SELECT p_partkey FROM part WHERE p_size > 30")
def filter_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return _session(spark, sf).filter("Part", lambda df: df["p_size"] > 30).select("p_partkey")


@built("SELECT 7 AS id, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def entity_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return _session(spark, sf).entity("Orders", 7).select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice")


@built("SELECT 'Customer' AS _type, count(*) AS rows, 4 * count(*) AS properties FROM customer UNION ALL SELECT 'Nation', count(*), 2 * count(*) FROM nation UNION ALL SELECT 'Region', count(*), count(*) FROM region")
def all_entities(spark: SparkSession, sf: str) -> DataFrame:
    df = stats.all_entities(load(spark, sf).catalog).where("_type IN ('Customer', 'Nation', 'Region')")
    return df.groupBy("_type").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("properties")).alias("properties"))


@built("SELECT 'PLACED' AS _type, count(*) AS n, min(o_custkey) AS lo, max(o_orderkey) AS hi FROM orders UNION ALL SELECT 'PART_OF', count(*), min(n_nationkey), max(n_regionkey) FROM nation")
def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _session(spark, sf).edges("PLACED", "PART_OF").groupBy("_type").agg(F.count(F.lit(1)).alias("n"), F.min("_src").alias("lo"), F.max("_dst").alias("hi"))


@built("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)) / count(*) AS avg_degree FROM customer")
def average_degree(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf).catalog
    return stats.collection_stats(c, "Customer", c.edges["PLACED"]).select("avg_degree")


@built("""WITH RECURSIVE e AS (SELECT * FROM (SELECT o_orderkey AS s, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders) WHERE d IS NOT NULL),
p AS (SELECT o_orderkey AS v FROM orders WHERE o_totalprice > 50000), f AS (SELECT min(s) AS v FROM e JOIN p ON p.v = s),
w AS (SELECT d AS k, 1 AS depth FROM e, f WHERE s = f.v AND d IN (SELECT v FROM p) UNION ALL SELECT d, depth + 1 FROM w JOIN e ON s = k WHERE d IN (SELECT v FROM p)) SELECT k AS o_orderkey, CAST(min(depth) AS INT) AS depth FROM w GROUP BY k""")
def traverse_filtered(spark: SparkSession, sf: str) -> DataFrame:
    s = _session(spark, sf)
    first = s.execute("FROM Orders a WHERE a.o_totalprice > 50000 TRAVERSE -[:NEXT]-> b SELECT MIN(a.o_orderkey) AS k").first()[0]
    return s.traverse("Orders", first, "NEXT", 1000, lambda df: df["o_totalprice"] > 50000)


@built("SELECT o_orderkey AS a, lead(o_orderkey, 3) OVER w AS b, CAST(3 AS INT) AS d, concat_ws(' ', o_orderkey, lead(o_orderkey) OVER w, lead(o_orderkey, 2) OVER w, lead(o_orderkey, 3) OVER w) AS path FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) QUALIFY b IS NOT NULL")
def path_statement(spark: SparkSession, sf: str) -> DataFrame:
    df = _session(spark, sf).execute("FROM Orders x TRAVERSE -[:NEXT*3..3]-> y SHORTEST PATH SELECT x.o_orderkey AS a, y.o_orderkey AS b, DEPTH(y) AS d, PATH")
    return df.select("a", "b", "d", F.array_join("PATH", " ").alias("path"))


# changes by statements
@built("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (50, 'x'), (51, 'y'), (52, 'z'))")
def insert_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are given stay, later ones count on."""
    s = _session(spark, sf, "INSERT INTO Region VALUES ({r_regionkey: 50, r_name: 'x'})", "INSERT INTO Region (r_name) VALUES ('y'), ('z')")
    return s.execute("FROM Region SELECT *")


@built("SELECT 1 AS id, 'a' AS name, 8 AS age UNION ALL SELECT 3, 'c', 7")
def sql_statements(spark: SparkSession, sf: str) -> DataFrame:
    s = _session(spark, sf, "CREATE TABLE people (id INTEGER PRIMARY KEY, name VARCHAR(20), age INTEGER DEFAULT 7)", "INSERT INTO people (id, name) VALUES (1, 'a'), (2, 'b')", "INSERT INTO people (name) VALUES ('c')", "UPDATE people SET age = age + 1 WHERE name = 'a'", "DELETE FROM people WHERE id = 2")
    return s.sql("SELECT id, name, age FROM people")


@built("SELECT 'x' AS a, 'y' AS b, 3 AS w")
def cypher_create(spark: SparkSession, sf: str) -> DataFrame:
    s = _session(spark, sf, "CREATE (a:Person {name: 'x'})-[:KNOWS {w: 3}]->(b:Person {name: 'y'})")
    return s.cypher("MATCH (p:Person)-[k:KNOWS]->(q:Person) RETURN p.name AS a, q.name AS b, k.w AS w")


@built("SELECT CAST(unnest(['i', 'u']) AS VARCHAR) AS name, unnest(['Part', 'Orders']) AS collection, unnest(['p_size', 'o_orderkey']) AS property, unnest([false, true]) AS is_unique")
def index_statements(spark: SparkSession, sf: str) -> DataFrame:
    s = _session(spark, sf, "CREATE INDEX i ON Part(p_size)", "CREATE UNIQUE INDEX u ON Orders(o_orderkey)", "CREATE INDEX j ON Part(p_brand)", "DROP INDEX j")
    return indexes.listed(s.catalog, spark)


@built("SELECT unnest(['create', 'insert', 'update', 'insert new']) AS what, unnest([true, true, true, false]) AS refused")
def index_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """A unique index is kept to by every later statement."""
    s = _session(spark, sf, "CREATE UNIQUE INDEX u ON Nation(n_name)")
    found = [("create", "CREATE UNIQUE INDEX v ON Nation(n_regionkey)"), ("insert", "INSERT INTO Nation VALUES ({n_nationkey: 90, n_name: 'NATION_3', n_regionkey: 1})"), ("update", "UPDATE Nation SET n_name = 'one'"), ("insert new", "INSERT INTO Nation VALUES ({n_nationkey: 91, n_name: 'new', n_regionkey: 1})")]
    return spark.createDataFrame([(k, _refused(s, x)) for k, x in found], "what string, refused boolean")


@built("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def index_clustered(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.between(indexes.clustered(table(spark, sf, "orders"), "o_totalprice"), "o_totalprice", 100000, 120000).select("o_orderkey")


@built("SELECT (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS customers, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3) AS placed")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    s = _session(spark, sf, "DELETE FROM Customer WHERE c_nationkey = 3 CASCADE")
    rows = s.execute("FROM Customer SELECT COUNT(*) AS customers")
    return rows.join(F.broadcast(s.edges("PLACED").agg(F.count(F.lit(1)).alias("placed"))))


@built("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'NEAR' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_through(spark: SparkSession, sf: str) -> DataFrame:
    s = _session(spark, sf, "FROM Nation n WHERE n.n_nationkey = 3 TRAVERSE <-[:LIVES_IN]- c UPDATE c {c_acctbal: c.c_acctbal + 100, c_mktsegment: 'NEAR'}")
    return s.execute("FROM Customer SELECT c_custkey, c_acctbal, c_mktsegment")


@built("SELECT DISTINCT o_custkey AS a, l_partkey AS b, 1 AS since FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def create_through(spark: SparkSession, sf: str) -> DataFrame:
    s = _session(spark, sf, "FROM Customer c TRAVERSE -[:PLACED]-> o TRAVERSE -[e:CONTAINS]-> p WHERE e.l_quantity > 45 CREATE (c)-[:LIKES]->(p) {since: 1}")
    return s.execute("FROM Customer c TRAVERSE -[k:LIKES]-> p SELECT c.c_custkey AS a, p.p_partkey AS b, k.since AS since")


@built("SELECT count(*) AS rows, 20 AS changes, 25 AS first FROM nation")
def many_changes(spark: SparkSession, sf: str) -> DataFrame:
    """After so many updates the table has been written out in between."""
    s = _session(spark, sf, *["UPDATE Nation SET n_regionkey = n_regionkey + 1"] * 20)
    return s.execute("FROM Nation SELECT COUNT(*) AS rows, MAX(n_regionkey) AS m, COUNT(*) AS first").join(F.broadcast(table(spark, sf, "nation").agg(F.max("n_regionkey").alias("was")))).select("rows", (F.col("m") - F.col("was")).cast("int").alias("changes"), F.col("first").cast("int").alias("first"))


# schemas
@built("SELECT unnest(['missing', 'null', 'type', 'check', 'unique', 'primary', 'update check', 'update null', 'update unique', 'fine', 'whole number']) AS what, unnest([true, true, true, true, true, true, true, true, true, false, false]) AS refused")
def schema_statements(spark: SparkSession, sf: str) -> DataFrame:
    """What INSERT and UPDATE refuse by the constraints of CREATE TABLE."""
    s = _session(spark, sf, "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, age INTEGER CHECK (age >= 18 AND age <= 120), mail TEXT UNIQUE, score DOUBLE DEFAULT 1.5)", "INSERT INTO t (id, name, age, mail) VALUES (1, 'a', 20, 'p'), (2, 'b', 30, 'q')")
    tried = [
        ("missing", "INSERT INTO t (id, age) VALUES (3, 20)"), ("null", "INSERT INTO t (id, name) VALUES (3, NULL)"), ("type", "INSERT INTO t (id, name, age) VALUES (3, 'c', 'x')"), ("check", "INSERT INTO t (id, name, age) VALUES (3, 'c', 5)"),
        ("unique", "INSERT INTO t (id, name, mail) VALUES (3, 'c', 'q')"), ("primary", "INSERT INTO t (id, name) VALUES (2, 'c')"), ("update check", "UPDATE t SET age = 150 WHERE id = 1"), ("update null", "UPDATE t SET name = NULL WHERE id = 1"), ("update unique", "UPDATE t SET mail = 'p'"),
        ("fine", "INSERT INTO t (id, name, age, mail) VALUES (4, 'd', 18, 'r')"), ("whole number", "INSERT INTO t (id, name, score) VALUES (5, 'e', 2)"),
    ]
    return spark.createDataFrame([(k, _refused(s, x)) for k, x in tried], "what string, refused boolean")


_FIELD = constraints.Field


@built("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'c_name:missing' ELSE '' END || CASE WHEN c_acctbal IS NOT NULL THEN ',c_acctbal:type' ELSE '' END || ',extra:unknown' AS errors FROM customer")
def schema_kinds(spark: SparkSession, sf: str) -> DataFrame:
    schema = constraints.Schema((_FIELD("c_custkey", "bigint", primary=True), _FIELD("c_name", "string", required=True), _FIELD("c_acctbal", "bigint")))
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"), "c_acctbal", F.lit(1).alias("extra"))
    found = F.transform("errors", lambda x: F.concat(x["field"], F.lit(":"), x["problem"]))
    return schema.validated(df).select("c_custkey", F.concat(F.coalesce(F.get(F.filter(found, lambda x: x == "c_name:missing"), F.lit(0)), F.lit("")), F.lit(","), F.array_join(F.filter(found, lambda x: x != "c_name:missing"), ",")).alias("errors"))


@built("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS problems FROM customer")
def schema_update(spark: SparkSession, sf: str) -> DataFrame:
    """An update's check looks at touched fields alone: the missing name doesn't count."""
    schema = constraints.Schema((_FIELD("c_name", "string", required=True), _FIELD("c_acctbal", "double", check="c_acctbal >= 0"), _FIELD("c_custkey", "bigint")))
    df = table(spark, sf, "customer").select("c_custkey", F.lit(None).cast("string").alias("c_name"), "c_acctbal")
    return schema.validated(df, {"c_acctbal"}).select("c_custkey", F.size("errors").alias("problems"))


@built("SELECT s_suppkey, 'none' AS note, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS s_nationkey FROM supplier")
def schema_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """A field that lacks gets its default; a null that is there stays."""
    schema = constraints.Schema((_FIELD("note", "string", default="none"), _FIELD("s_nationkey", "bigint", default=5)), extra=True)
    return schema.with_defaults(table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("s_nationkey"))).select("s_suppkey", "note", "s_nationkey")


@built("SELECT 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def schema_unique(spark: SparkSession, sf: str) -> DataFrame:
    return constraints.Schema((_FIELD("o_orderkey", "bigint", primary=True), _FIELD("o_custkey", "bigint", unique=True)), extra=True).repeated(table(spark, sf, "orders"))


# transactions, logs
@built("SELECT 'first' AS winner, true AS refused, 26 AS rows")
def transaction_conflict(spark: SparkSession, sf: str) -> DataFrame:
    db = load(spark, sf)
    a, b = db.session(), db.session()
    for s, name in ((a, "first"), (b, "second")):
        s.execute("BEGIN")
        s.execute(f"INSERT INTO Nation VALUES ({{n_nationkey: 70, n_name: '{name}', n_regionkey: 0}})")
    a.execute("COMMIT")
    try:
        b.execute("COMMIT")
        refused = False
    except TransactionError:
        refused = True
    s = db.session()
    return spark.createDataFrame([(s.execute("FROM Nation WHERE n_nationkey = 70 SELECT n_name").first()[0], refused, s.execute("FROM Nation SELECT COUNT(*) AS n").first()[0])], "winner string, refused boolean, rows int")


@built("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 40, 'new'")
def log_replay(spark: SparkSession, sf: str) -> DataFrame:
    """What a log of row images gives on the tables as they were: committed changes alone."""
    db = load(spark, sf)
    db.images, db.log_folder = True, new_path(spark, "log")
    before, s = db.catalog.copy(), db.session()
    for x in ("INSERT INTO Nation VALUES ({n_nationkey: 40, n_name: 'new', n_regionkey: 9})", "UPDATE Nation SET n_name = 'one' WHERE n_regionkey = 1", "DELETE FROM Nation WHERE n_regionkey = 2", "BEGIN", "DELETE FROM Nation", "ROLLBACK"):
        s.execute(x)
    db.flush()
    return log.replay(spark, db.log_folder, before).collection("Nation").df.select("n_nationkey", "n_name")


@built("SELECT unnest([1, 2, 3]) AS txn, unnest(['committed', 'aborted', 'active']) AS outcome, unnest([2, 1, 0]) AS changes")
def log_folder(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "log")
    log.append(spark, folder, [(1, 1, "begin", ""), (2, 1, "insert", "x"), (3, 2, "begin", ""), (4, 1, "update", "y")])
    log.append(spark, folder, [(5, 2, "delete", "z"), (6, 2, "rollback", ""), (7, 1, "commit", ""), (8, 3, "begin", "")])
    return versions.outcomes(log.read(spark, folder)).select(F.col("txn").cast("int").alias("txn"), "outcome", F.col("changes").cast("int").alias("changes"))


@built("SELECT unnest(['begin', 'insert', 'commit', 'begin', 'rollback']) AS kind, unnest([1, 2, 3, 4, 5]) AS pos")
def log_statements(spark: SparkSession, sf: str) -> DataFrame:
    db = Database(spark)
    s = db.session()
    for x in ("CREATE Item {a: 1}", "BEGIN", "ROLLBACK"):
        s.execute(x)
    return db.log_frame().select("kind", F.col("pos").cast("int").alias("pos"))


# sources and sinks
@built("SELECT n_nationkey, n_name, n_regionkey, true AS verified, 1 AS listed FROM nation")
def backup_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    c, whole, folder = Database(spark).catalog, load(spark, sf).catalog, new_path(spark, "backups")
    c.collections["Nation"], c.collections["Region"], c.edges["PART_OF"] = whole.collections["Nation"], whole.collections["Region"], whole.edges["PART_OF"]
    gone, name = backup.create(spark, c, folder, gzip=False), backup.create(spark, c, folder)
    backup.delete(spark, folder, gone)
    back = backup.restore(spark, folder, name)
    return back.collection("Nation").df.select("n_nationkey", "n_name", "n_regionkey", F.lit(backup.verify(spark, folder, name)).alias("verified"), F.lit(backup.listed(spark, folder).count()).cast("int").alias("listed"))


@built("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "csv")
    write_csv(table(spark, sf, "nation"), path)
    return read_csv(spark, path, "n_nationkey BIGINT, n_name STRING, n_regionkey BIGINT")


# streams: what they give in the end is what the batch gives
@built("SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, event_type, count(*) AS events FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.sliding(table(spark, sf, "events"), "1 hour", "30 minutes")


@built("WITH c AS (SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM c) UNION ALL SELECT user_id, value FROM c WHERE t <> 'error'")
def stream_replicate(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed as files that a stream applies batch by batch; each batch's table is written and read by the next."""
    at = {0: new_path(spark), 1: new_path(spark)}
    feed, state = new_path(spark), {"path": None}
    base = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("action"), F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"))
    for part in range(2):  # two files, the later changes in the second
        half = e.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] if part == 0 else half  # noqa: F821
        e.where(F.col("seq") <= half if part == 0 else F.col("seq") > half).coalesce(1).write.mode("append").parquet(feed)

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(at[number % 2])
        state["path"] = at[number % 2]

    def read() -> DataFrame:
        return base if state["path"] is None else spark.read.schema(base.schema).parquet(state["path"])

    stream = feeds.feed(spark, feed, "seq bigint, action string, c_custkey bigint, c_acctbal double")
    feeds.replicate(stream, "c_custkey", read, write, new_path(spark, "checkpoints")).awaitTermination()
    return read()


@built("SELECT event_type AS replica, count(*) AS kept FROM events WHERE event_id > (SELECT min(m) FROM (SELECT max(event_id) AS m FROM events WHERE event_id % 4 <> 0 GROUP BY event_type)) GROUP BY 1")
def repl_trim(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("replica"))
    return versions.trimmed(e, e.where("seq % 4 <> 0")).groupBy("replica").agg(F.count(F.lit(1)).alias("kept"))


@built("SELECT shard FROM (SELECT unnest(range(1024))::INT AS shard)")
def shard_map_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every shard has its primary and two copies on other nodes."""
    placed = shards.shard_map(spark, shards.Ring(["a", "b", "c", "d"]))
    return placed.groupBy("shard").agg(F.count_distinct("node").alias("n"), F.count(F.when(F.col("copy") == 0, 1)).alias("p")).where("n = 3 AND p = 1").select("shard")


@built("SELECT user_id, round(p * (s / n) / (1 + m / 100.0), 9) AS quality FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS s, min(event_id) % 200 AS m, CAST(0.125 + (user_id % 64) / 8.0 AS DOUBLE) AS p FROM events GROUP BY user_id)")
def trail_quality(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("successes"), (F.min("event_id") % 200).alias("ms"))
    t = t.withColumn("pheromone", F.lit(0.125) + F.pmod("user_id", F.lit(64)) / 8.0)
    return pheromone.trail_quality(t).select("user_id", F.round("quality", 9).alias("quality"))


@built("SELECT 2 AS left_edges, true AS gone")
def drop_collection(spark: SparkSession, sf: str) -> DataFrame:
    """Edge types to a collection go with it."""
    db = load(spark, sf)
    c = db.catalog
    for k in [k for k in c.edges if k not in ("PLACED", "LIVES_IN", "SITS_IN")]:
        del c.edges[k]
    changes.drop_collection(c, "Orders")
    return spark.createDataFrame([(len(c.edges), not c.has("Orders"))], "left_edges int, gone boolean")
