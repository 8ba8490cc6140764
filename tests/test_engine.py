import random
from collections import deque
from itertools import product

import pytest

from fernwork.functions.expressions import QueryError
from fernwork.operators import paths, stats
from fernwork.plans import nodes as n
from fernwork.session import Database, TransactionError


def db_of(spark, tables, edges=()):
    db = Database(spark)
    for name, schema, rows, key in tables:
        db.catalog.add(name, spark.createDataFrame(rows, schema), key)
    for name, rows, a, b in edges:
        db.catalog.add_edge(name, spark.createDataFrame(rows, "s bigint, d bigint, w bigint"), "s", "d", a, b)
    return db


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


#: Stations with nulls in every property, equal heights and digits as text; lines between them, two of them parallel.
STATIONS = [(10, "quarry", 480, "3"), (11, "mill", None, "4"), (12, "weir", 305, None), (13, None, 305, "3"), (14, "lock", 120, "x"), (15, "pier", None, None)]
LINES = [(10, 11, 7), (10, 12, 2), (11, 14, 9), (12, 10, 4), (12, 10, 5), (14, 15, 1)]


@pytest.fixture
def stations(spark):
    return db_of(spark, [("Station", "id bigint, label string, height bigint, zone string", STATIONS, "id")], [("LINE", LINES, "Station", "Station")])


def test_filters(stations):
    s = stations.session()
    assert rows(s.execute("FROM Station WHERE height > 120 SELECT id")) == [(10,), (12,), (13,)]
    assert rows(s.execute("FROM Station WHERE NOT height > 120 SELECT id")) == [(11,), (14,), (15,)]
    assert rows(s.execute("FROM Station WHERE zone = '3' SELECT id")) == [(10,), (13,)]
    assert rows(s.execute("FROM Station SELECT id, height ORDER BY height DESC, id LIMIT 3 OFFSET 2")) == [(11, None), (13, 305), (14, 120)]
    assert s.execute("FROM Station SELECT label LIMIT 0").count() == 0


def test_values_of_different_types(stations):
    s = stations.session()
    for never in ("zone = 3", "zone > 3", "height = 'x'", "height < 'x'", "label = TRUE"):
        assert s.execute(f"FROM Station WHERE {never} SELECT id").count() == 0
    for always in ("zone != 3", "NOT zone > 3", "height != 'x'", "NOT height < 'x'"):
        assert s.execute(f"FROM Station WHERE {always} SELECT id").count() == 6
    assert rows(s.execute("FROM Station WHERE zone = height SELECT id")) == [(15,)]  # both are null
    assert rows(s.execute("FROM Station WHERE height = 305.0 SELECT id")) == [(12,), (13,)]
    # SQL turns values to the other side's type; what can't be turned matches nothing
    assert rows(s.sql("SELECT id FROM Station WHERE zone = 3")) == [(10,), (13,)]
    assert rows(s.sql("SELECT id FROM Station WHERE zone <> 3")) == [(11,)]
    assert rows(s.sql("SELECT id FROM Station WHERE height = '305'")) == [(12,), (13,)]
    assert s.sql("SELECT id FROM Station WHERE height = 'tall'").count() == 0
    # Cypher: unequal, and in no order; nulls match nothing
    assert s.execute("MATCH (x:Station) WHERE x.zone = 3 OR x.zone > 3 RETURN x.id").count() == 0
    assert s.execute("MATCH (x:Station) WHERE x.zone <> 3 RETURN x.id").count() == 4


def test_hops(stations):
    s = stations.session()
    assert rows(s.execute("FROM Station u TRAVERSE -[:LINE]-> v WHERE u.id = 10 SELECT v.label")) == [("mill",), ("weir",)]
    assert rows(s.execute("FROM Station u TRAVERSE <-[:LINE]- v WHERE u.id = 10 SELECT v.label")) == [("weir",), ("weir",)]
    assert s.execute("FROM Station u TRAVERSE <-[:LINE]-> v SELECT v.label").count() == 12
    got = s.execute("FROM Station u TRAVERSE -[p:LINE*1..2]-> v WHERE u.label = 'quarry' SELECT v.id, p.depth")
    assert rows(got) == [(11, 1), (12, 1), (14, 2)]
    assert rows(s.execute("FROM Station u TRAVERSE -[e:LINE]-> v WHERE e.w > 6 SELECT u.id, v.id")) == [(10, 11), (11, 14)]
    assert rows(s.execute("FROM Station u TRAVERSE -[:LINE]-> v TRAVERSE -[:LINE]-> w WHERE u.id = 12 SELECT v.id, w.id")) == [(10, 11), (10, 11), (10, 12), (10, 12)]
    assert rows(s.execute("FROM Station u TRAVERSE -[:LINE]-> v, <-[:LINE]- w WHERE u.id = 14 SELECT v.id, w.id")) == [(15, 11)]
    assert rows(s.traverse("Station", 10, "LINE", 9)) == [(11, 1), (12, 1), (14, 2), (15, 3)]
    assert rows(s.traverse("Station", 10, "LINE", 9, lambda df: df["id"] != 11)) == [(12, 1)]
    got = s.execute("FROM Station u WHERE u.id = 12 TRAVERSE -[:LINE*]-> v WHERE v.id = 15 SHORTEST PATH SELECT PATH, DEPTH(v) AS d")
    assert [(r["PATH"], r["d"]) for r in got.collect()] == [([12, 10, 11, 14, 15], 4)]


def test_chain_pairs(spark):
    db = db_of(spark, [("Stop", "id bigint", [(i,) for i in range(7)], "id")], [("NEXT", [(i, i + 1, 0) for i in range(6)], "Stop", "Stop")])
    pairs = {hops: [(a, b) for a in range(7) for b in range(7) if b - a in hops] for hops in (range(1, 4), range(1, 7), range(2, 7), range(2, 3))}
    for hops, text in zip(pairs, ("*1..3", "*", "*2..", "*2"), strict=True):
        assert rows(db.session().execute(f"FROM Stop a TRAVERSE -[:NEXT{text}]-> b SELECT a.id, b.id")) == pairs[hops]


def test_cypher(stations):
    s = stations.session()
    assert rows(s.execute("MATCH (u:Station {label: 'quarry'})-[:LINE]->(v:Station) RETURN v.label")) == [("mill",), ("weir",)]
    assert s.execute("MATCH (u:Station)-[:LINE]->(v:Station) RETURN u.label, v.label").columns == ["u.label", "v.label"]
    assert rows(s.execute("MATCH (a:Station)-[:LINE]->(b:Station)-[:LINE]->(a) RETURN a.id AS x")) == [(10,), (10,), (12,), (12,)]
    assert s.execute("MATCH (a:Station) WHERE a.id = 12 RETURN a").first()["a"]["label"] == "weir"
    s.execute("CREATE (x:Station {label: 'dock', height: 2})-[:FEEDS {kind: 'water'}]->(y:Basin {size: 8})")
    assert rows(s.execute("MATCH (x:Station)-[k:FEEDS]->(y:Basin) RETURN x.label AS n, k.kind AS s, y.size AS k")) == [("dock", "water", 8)]


def test_queries_inside_queries(stations):
    s = stations.session()
    assert rows(s.sql("SELECT id FROM Station WHERE height IN (SELECT height FROM Station WHERE label = 'weir')")) == [(12,), (13,)]
    assert s.sql("SELECT id FROM Station WHERE id NOT IN (SELECT height FROM Station)").count() == 0  # a null among them
    assert rows(s.sql("SELECT id FROM Station WHERE id NOT IN (SELECT id FROM Station WHERE height > 200)")) == [(11,), (14,), (15,)]
    assert s.sql("SELECT id FROM Station WHERE height NOT IN (SELECT id FROM Station WHERE id > 99)").count() == 6
    assert rows(s.execute("FROM Station WHERE zone IN (FROM Station WHERE id = 15 SELECT zone) SELECT id")) == [(12,), (15,)]  # null is null
    assert rows(s.sql("SELECT a.id FROM Station a WHERE EXISTS (SELECT * FROM Station b WHERE b.height = a.height AND b.id > a.id)")) == [(12,)]
    assert rows(s.sql("SELECT a.id FROM Station a WHERE a.height > 0 AND NOT EXISTS (SELECT * FROM Station b WHERE b.height < a.height)")) == [(14,)]
    assert rows(s.sql("SELECT id FROM Station WHERE height = (SELECT MAX(height) FROM Station)")) == [(10,)]
    assert rows(s.sql("WITH high AS (SELECT id FROM Station WHERE height > 300), low AS (SELECT id FROM high WHERE id < 13) SELECT COUNT(*) AS n FROM low")) == [(2,)]
    with pytest.raises(QueryError):
        s.sql("SELECT id FROM Station WHERE id = 1 OR id IN (SELECT id FROM Station)")
    with pytest.raises(Exception, match="more than one row"):
        s.sql("SELECT id FROM Station WHERE id = (SELECT id FROM Station)").collect()


def test_window_text(stations):
    s = stations.session()
    got = rows(s.execute("FROM Station SELECT id, RANK() OVER (ORDER BY height) AS r, SUM(height) OVER (PARTITION BY zone ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS t"))
    assert got == [(10, 4, 480), (11, 5, None), (12, 2, 305), (13, 2, 785), (14, 1, 120), (15, 5, 305)]
    assert rows(s.sql("SELECT id, LAG(id, 2) OVER (ORDER BY id DESC) AS b FROM Station WHERE id < 13")) == [(10, 12), (11, None), (12, None)]


def test_as_of_text(spark):
    db = db_of(spark, [("Price", "at bigint, item string, price bigint", [(1, "a", 5), (4, "a", 6), (2, "b", 9)], None), ("Sale", "n bigint, at bigint, item string", [(1, 3, "a"), (2, 4, "a"), (3, 0, "a"), (4, 9, "c")], "n")])
    s = db.session()
    assert rows(s.sql("SELECT s.n, p.price FROM sale s ASOF LEFT JOIN price p ON s.item = p.item AND s.at >= p.at")) == [(1, 5), (2, 6), (3, None), (4, None)]
    assert rows(s.sql("SELECT s.n, p.price FROM sale s ASOF JOIN price p ON s.item = p.item AND p.at <= s.at WHERE p.price > 5")) == [(2, 6)]
    with pytest.raises(QueryError):
        s.sql("SELECT s.n FROM sale s ASOF JOIN price p ON s.item = p.item AND s.at <= p.at")


def test_grouping(spark):
    data = [(u, d, 1 + u % 5, 10 + u % 60) for d in range(1, 8) for u in range(1, 101)]
    db = db_of(spark, [("A", "user_id bigint, day bigint, sessions bigint, duration bigint", data, None)])
    s = db.session()
    assert {tuple(r) for r in s.execute("FROM A SELECT day, COUNT(*) AS n, SUM(sessions) AS t GROUP BY day").collect()} == {(d, 100, 300.0) for d in range(1, 8)}
    assert s.execute("FROM A SELECT user_id, SUM(duration) AS t GROUP BY user_id HAVING SUM(duration) > 200").count() == 63
    assert s.execute("FROM A SELECT user_id, SUM(duration) AS t GROUP BY user_id HAVING t > 200").count() == 63
    assert rows(s.execute("FROM A WHERE day > 99 SELECT COUNT(*), SUM(sessions), MAX(day)")) == [(0, 0.0, None)]
    assert s.execute("FROM A SELECT COUNT(*), SUM(day), day + 1 GROUP BY day").columns == ["agg_0", "agg_1", "col_2"]


def test_nulls(spark):
    db = db_of(spark, [("Items", "count bigint, name string, active boolean", [(42, None, None), (None, "test", None), (None, None, True)], None)])
    s = db.session()
    assert s.execute("FROM Items WHERE count != 5 SELECT *").count() == 3
    assert s.sql("SELECT * FROM Items WHERE count != 5").count() == 1
    assert s.execute("FROM Items WHERE count = null SELECT *").count() == 2
    assert s.execute("FROM Items WHERE NOT count > 5 SELECT *").count() == 2
    assert s.execute("FROM Items WHERE active SELECT *").count() == 1
    assert s.execute("FROM Items WHERE NOT active SELECT *").count() == 2
    assert rows(s.execute("FROM Items SELECT COUNT(name) AS a, COUNT(DISTINCT name) AS b")) == [(3, 1)]
    assert rows(s.sql("SELECT COUNT(name) AS a FROM Items")) == [(1,)]
    assert [r[0] for r in s.execute("FROM Items SELECT count ORDER BY count DESC").collect()] == [42, None, None]
    assert rows(s.execute("FROM Items WHERE count = 42 SELECT count / 0 AS a, count + 1 AS b")) == [(None, 43)]


def test_arithmetic_on_strings(stations):
    s = stations.session()
    assert rows(s.execute("FROM Station WHERE id = 10 SELECT label + 1 AS a, height * 2 AS b, 'x' - height AS c")) == [(None, 960, None)]
    assert rows(s.sql("SELECT label + 1 AS a, '2' * height AS b FROM Station WHERE id = 10")) == [(None, 960.0)]
    s.execute("UPDATE Station SET height = zone + 1 WHERE id = 10")
    assert rows(s.execute("FROM Station WHERE id = 10 SELECT height")) == [(None,)]


def two_valued(e, row):
    """Reference evaluator of the two-valued mode."""
    if isinstance(e, n.Not):
        return not two_valued(e.arg, row)
    if e.op in ("and", "or"):
        a, b = two_valued(e.left, row), two_valued(e.right, row)
        return a and b if e.op == "and" else a or b
    a, b = (x.value if isinstance(x, n.Lit) else row[x.name] for x in (e.left, e.right))
    if e.op in ("=", "!="):
        return (a == b) == (e.op == "=")
    return a is not None and b is not None and {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op] if a is not None and b is not None else False


def test_two_valued_truth(spark):
    from fernwork.plans.compiler import compile_select

    values = [None, 1, 2]
    data = [(k, a, b) for k, (a, b) in enumerate(product(values, values))]
    db = db_of(spark, [("T", "k bigint, a bigint, b bigint", data, "k")])
    rng = random.Random(3)

    def made(depth):
        if depth and rng.random() < 0.6:
            return n.Not(made(depth - 1)) if rng.random() < 0.4 else n.Op(rng.choice(["and", "or"]), made(depth - 1), made(depth - 1))
        term = lambda: rng.choice([n.Prop(None, "a"), n.Prop(None, "b"), n.Lit(1), n.Lit(None)])
        return n.Op(rng.choice(["=", "!=", "<", "<=", ">", ">="]), n.Prop(None, rng.choice("ab")), term())

    for _ in range(25):
        e = made(3)
        got = {r[0] for r in compile_select(db.catalog, n.Select("T", "T", where=e, items=[n.Item(n.Prop(None, "k"))])).collect()}
        assert got == {k for k, a, b in data if two_valued(e, {"a": a, "b": b})}, e


@pytest.mark.parametrize("seed", range(3))
def test_reachable_is_bfs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)]
    least, most = rng.choice([(1, None), (2, 3), (1, 5)])
    df = spark.createDataFrame(edges, "_src bigint, _dst bigint")
    got = {tuple(r) for r in paths.reachable(spark.createDataFrame([(i,) for i in range(12)], "_src bigint"), df, least, most).collect()}
    want = set()
    for s in range(12):
        seen, todo = {s: 0}, deque([s])
        while todo:
            v = todo.popleft()
            for a, b in edges:
                if a == v and b not in seen:
                    seen[b] = seen[v] + 1
                    todo.append(b)
        want |= {(s, v, d) for v, d in seen.items() if d >= least and (most is None or d <= most)}
    assert got == want


def test_changes(stations):
    db = stations
    s = db.session()
    r = s.execute("INSERT INTO Station VALUES ({label: 'dam', height: 50, owner: 'city'})").first()
    assert (r["rows_affected"], r["ids"]) == (1, [16])
    assert rows(s.execute("FROM Station WHERE owner = 'city' SELECT id, label")) == [(16, "dam")]
    assert s.execute("UPDATE Station SET height = height + 1, label = 'high' WHERE height > 300").first()[0] == 3
    assert rows(s.execute("FROM Station WHERE label = 'high' SELECT height")) == [(306,), (306,), (481,)]
    assert s.execute("DELETE FROM Station WHERE id = 14").first()[0] == 1
    assert s.execute("FROM Station a TRAVERSE -[:LINE]-> b SELECT a.id").count() == 4 and db.catalog.edges["LINE"].df.count() == 6
    assert s.execute("DELETE FROM Station WHERE id = 12 CASCADE").first()[0] == 1
    assert rows(db.catalog.edges["LINE"].df.select("s", "d")) == [(10, 11)]
    s.sql("CREATE TABLE t (id INTEGER, name TEXT)")
    s.sql("INSERT INTO t (id, name) VALUES (1, 'a'), (2, 'b')")
    assert rows(s.sql("SELECT name FROM t WHERE id = 2")) == [("b",)]
    s.execute("INSERT INTO New VALUES ({x: 1.5})")
    assert rows(s.execute("FROM New SELECT x")) == [(1.5,)]


def test_changes_through_traversals(stations):
    s = stations.session()
    assert s.execute("FROM Station a WHERE a.id = 12 TRAVERSE -[:LINE]-> b UPDATE b {height: b.height + 1, zone: 'new'}").first()[0] == 1  # reached twice, changed once
    assert rows(s.execute("FROM Station WHERE zone = 'new' SELECT id, height")) == [(10, 481)]
    assert s.execute("FROM Station WHERE label = 'lock' UPDATE {height: 0}").first()[0] == 1
    assert s.execute("FROM Station a TRAVERSE -[:LINE]-> b TRAVERSE -[:LINE]-> c CREATE (a)-[:NEAR]->(c) {hops: 2}").first()[0] == 5
    assert rows(s.execute("FROM Station a TRAVERSE -[k:NEAR]-> c WHERE a.id = 10 SELECT c.id, k.hops")) == [(10, 2), (14, 2)]


def test_committed_tables_stay_apart(stations):
    from fernwork.sources.scratch import folder

    s = stations.session()
    for k in range(17):
        s.execute(f"UPDATE Station SET height = height + {k} WHERE id = 10")
    assert f"{folder(s.spark)}/fernwork/{s.spark.sparkContext.applicationId}/tables/" in s.catalog.collection("Station").df.inputFiles()[0]
    assert rows(s.execute("FROM Station WHERE id = 10 SELECT height")) == [(480 + sum(range(17)),)]


def test_shared_folder(spark, monkeypatch):
    from fernwork.sources import scratch

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://far:7077", "applicationId": "app"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(Far)
    Far.sparkContext.master = "local[2]"
    assert scratch.folder(Far) == scratch.folder(Far)


def test_transactions(spark):
    db = db_of(spark, [("Tank", "id bigint, litres bigint", [(1, 70), (2, None), (3, 5)], "id")])
    a, b = db.session(), db.session()
    a.execute("BEGIN TRANSACTION")
    a.execute("UPDATE Tank SET litres = litres - 20 WHERE id = 1")
    a.execute("UPDATE Tank SET litres = 20 WHERE litres = NULL")
    assert rows(b.execute("FROM Tank SELECT litres")) == [(5,), (70,), (None,)]
    a.execute("COMMIT")
    assert rows(b.execute("FROM Tank SELECT litres")) == [(20,), (5,), (50,)]
    a.execute("BEGIN"), b.execute("BEGIN")
    a.execute("DELETE FROM Tank WHERE id = 1"), b.execute("DELETE FROM Tank WHERE id = 2")
    a.execute("COMMIT")
    with pytest.raises(TransactionError):
        b.execute("COMMIT")
    assert rows(b.execute("FROM Tank SELECT id")) == [(2,), (3,)]
    a.execute("BEGIN")
    a.execute("INSERT INTO Tank VALUES ({id: 9})")
    a.execute("ROLLBACK")
    assert a.execute("FROM Tank SELECT id").count() == 2
    with pytest.raises(TransactionError):
        a.execute("COMMIT")
    from fernwork.operators.versions import outcomes

    assert {r["outcome"] for r in outcomes(db.log_frame()).collect()} == {"committed", "aborted"}


def test_index_and_errors(stations):
    s = stations.session()
    s.execute("CREATE UNIQUE INDEX by_label ON Station(label)")
    with pytest.raises(QueryError):
        s.execute("INSERT INTO Station VALUES ({label: 'mill'})")
    s.execute("INSERT INTO Station VALUES ({height: 1}), ({height: 2})")  # nulls aren't indexed
    assert s.execute("FROM Station SELECT id").count() == 8
    with pytest.raises(QueryError):
        s.execute("UPDATE Station SET label = 'all'")
    with pytest.raises(QueryError):
        s.execute("CREATE UNIQUE INDEX by_height ON Station(height)")
    s.execute("DROP INDEX by_label")
    for bad in ("FROM Nope SELECT x", "FROM Station SELECT nope", "FROM Station TRAVERSE -[:NOPE]-> x SELECT x.y", "FROM Station SELECT FOO(label)", "FROM Station SELECT zone, COUNT(*) GROUP BY height"):
        with pytest.raises(QueryError):
            s.execute(bad).collect()


def test_filters_reach_the_scan(spark, tmp_path):
    from fernwork.session import Database

    spark.range(1000).selectExpr("id", "id % 7 AS a", "id % 5 AS b").write.parquet(str(tmp_path / "t"))
    db = Database(spark)
    db.catalog.add("T", spark.read.parquet(str(tmp_path / "t")), "id")
    plan = db.session().explain("FROM T WHERE a = 3 AND id < 100 SELECT a")["spark"]
    assert "EqualTo(a,3)" in plan and "LessThan(id,100)" in plan and "b:" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("hubs", [False, True])
def test_stats(stations, hubs):
    e = stations.catalog.edges["LINE"].ends().selectExpr("_src", "_dst", "'L' AS _type")
    assert rows(stats.degrees(e, "both", hubs)) == [(10, 3), (11, 2), (12, 2), (14, 2), (15, 1)]
    assert rows(stats.degrees(e, "in", hubs)) == [(10, 1), (11, 1), (12, 1), (14, 1), (15, 1)]
    g = stats.graph_stats(stations.catalog).first()
    assert (g["entities"], g["edges"], g["collections"], g["avg_pheromone"]) == (6, 6, 1, 1.0)
    c = stats.collection_stats(stations.catalog, "Station", stations.catalog.edges["LINE"]).first()
    assert (c["rows"], c["avg_properties"], c["avg_degree"]) == (6, 13 / 6, 5 / 6)
    assert stats.all_entities(stations.catalog).where("_id = 13").first()["properties"] == {"height": "305", "zone": "3"}


def test_foreign_keys(spark):
    """Hops along a key give what hops over the edge table give, and changed rows are walked by the edge table."""
    def made(foreign):
        db = db_of(spark, [("A", "id bigint, x bigint", [(1, 10), (2, 20), (3, 30)], "id"), ("B", "k bigint, a bigint", [(7, 1), (8, 1), (9, 2), (10, None), (11, 99)], "k")])
        db.catalog.add_edge("HAS", spark.createDataFrame([(1, 7), (1, 8), (2, 9), (99, 11)], "s bigint, d bigint"), "s", "d", "A", "B", foreign)
        return db.session()

    for q in ("FROM A a TRAVERSE -[:HAS]-> b SELECT a.x, b.k", "FROM B b TRAVERSE <-[:HAS]- a WHERE a.x > 10 SELECT a.x, b.k", "FROM A a TRAVERSE -[:HAS]-> b TRAVERSE <-[:HAS]- c SELECT a.id, b.k, c.x"):
        assert rows(made(("target", "a")).execute(q)) == rows(made(None).execute(q))
    s = made(("target", "a"))
    s.execute("UPDATE B SET a = 3 WHERE k = 7")
    assert rows(s.execute("FROM A a TRAVERSE -[:HAS]-> b SELECT a.id, b.k")) == [(1, 7), (1, 8), (2, 9)]
