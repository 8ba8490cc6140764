import pytest

from fernwork.plans import nodes as n
from fernwork.plans.lexer import QuerySyntaxError, tokenize
from fernwork.plans.parser import language, parse

VALID = [
    "FROM Orders WHERE o_totalprice > 20.5 SELECT o_orderkey, o_custkey",
    "FROM Customer c TRAVERSE -[:PLACED]-> o SELECT c.c_name, o.o_orderkey",
    "FROM Orders TRAVERSE -[:NEXT*1..3]-> Orders SELECT Orders.o_orderkey",
    "FROM Part WHERE p_size < 9 SELECT p_name, p_size ORDER BY p_size DESC, p_name LIMIT 5",
    "FROM Lineitem SELECT l_suppkey, SUM(l_quantity) AS q GROUP BY l_suppkey HAVING SUM(l_quantity) > 2 AND COUNT(*) < 9",
    "FROM Lineitem GROUP BY l_suppkey HAVING COUNT(*) > 1 SELECT l_suppkey, COUNT(*) AS n ORDER BY n",
    "FROM Nation n WHERE n.n_name = 'x' TRAVERSE <-[:LIVES_IN]- Customer AS c WHERE c.c_acctbal > 0 TRAVERSE -[:PLACED]-> o SELECT o.o_orderkey",
    "FROM Orders o WHERE o.o_orderkey = 1 TRAVERSE -[:NEXT*]-> p SHORTEST PATH SELECT PATH, DEPTH(p)",
    "FROM Orders o TRAVERSE -[:NEXT]-> p WITH EXPLORE RATE 0.3 OPTIMIZE WITH ants(5) SELECT p.o_orderkey",
    "FROM Nation n TRAVERSE <-[:LIVES_IN]- c UPDATE c {c_acctbal: c.c_acctbal * 2, c_mktsegment: 'y'}",
    "FROM Nation UPDATE {n_name: 'z'}", "FROM Orders a TRAVERSE -[:NEXT]-> b CREATE (a)<-[:BACK]-(b)", "CREATE Region {r_regionkey: 9, r_name: 'w'}",
    "UPDATE Part SET p_size = p_size - 1 WHERE p_partkey = 1", "DELETE FROM Part WHERE p_size = 3 CASCADE", "DELETE FROM Part CASCADE",
    "MATCH (s:Supplier)-[:SITS_IN]->(n:Nation) WHERE s.s_acctbal >= 10 RETURN n.n_name",
    "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 25 AND c_mktsegment = 'BUILDING' LIMIT 10",
    "SELECT a.x FROM t a ASOF LEFT JOIN u b ON a.k = b.k AND a.at >= b.at CROSS JOIN v",
    "SELECT x, ROW_NUMBER() OVER (PARTITION BY a, b ORDER BY c DESC, d ROWS BETWEEN UNBOUNDED PRECEDING AND 2 FOLLOWING) FROM t",
    "SELECT SUM(x) OVER () AS s, COUNT(*) OVER (ORDER BY a RANGE UNBOUNDED PRECEDING) AS c FROM t",
    "SELECT x FROM t WHERE x IN (SELECT y FROM u) AND NOT EXISTS (SELECT * FROM v WHERE v.a = t.x) AND x > (SELECT MAX(z) FROM w)",
    "WITH a AS (SELECT x FROM t), b AS (SELECT x FROM a) SELECT x FROM b INTERSECT ALL SELECT x FROM a EXCEPT ALL SELECT x FROM t",
    "WITH a AS (FROM t SELECT x) FROM a SELECT x", "SELECT a, b FROM t GROUP BY GROUPING SETS ((a, b), a, ())",
    "FROM a SELECT x OFFSET 3 LIMIT 2",
    "FROM a TRAVERSE <-[:T]- b SELECT b.x",
    "FROM a TRAVERSE -[:T]-> AS b TRAVERSE -[:S]-> c SELECT b.x",
    "FROM a WHERE x<-1 SELECT -x",
    "INSERT INTO Part VALUES ({count: 6, select: 'k', ok: false, none: null, d: -2.25})",
    "DELETE FROM Part", "CREATE UNIQUE INDEX i ON Part(p_name)", "DROP INDEX i", "CREATE (4)-[:NEXT]->(5) {at: 'x'}",
    "BEGIN TRANSACTION ISOLATION LEVEL SERIALIZABLE", "COMMIT", "ROLLBACK",
    "CREATE TABLE IF NOT EXISTS t (id INTEGER PRIMARY KEY, code VARCHAR(4) NOT NULL UNIQUE, n INT DEFAULT -1 CHECK (n < 5 OR n = 9))",
    "INSERT INTO t (a, b) VALUES (1, 'x'), (2, 'y')",
    "CREATE (a:Region {r_name: 'v'})-[:PART_OF {w: 1}]->(b:Region {r_name: 'u'})",
]


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    parse(text)


@pytest.mark.parametrize("text", ["FROM", "SELECT", "FROM a", "FROM a SELECT x FOO BAR BAZ", "FROM a SELECT x LIMIT y", "UPDATE a", "CREATE (1)-[:A|B]->(2)", "MATCH (a) RETURN a.x", "FROM a WHERE x = 'open SELECT x", "FROM a SELECT x ;;", "SELECT x OVER (ORDER BY y) FROM t", "SELECT COUNT(DISTINCT x) OVER (ORDER BY y) FROM t", "CREATE TABLE t (a INT WRONG)", "WITH a AS SELECT x FROM t SELECT x FROM a"])
def test_invalid(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_tokens():
    assert [t.text for t in tokenize(r"x1 1..3 2.5 'a\n''b' `odd name` <= <>")][:-1] == ["x1", "1", "..", "3", "2.5", "a\n'b", "odd name", "<=", "<>"]


@pytest.mark.parametrize("text,least,most", [("*", 1, None), ("*2", 2, 2), ("*..4", 1, 4), ("*2..", 2, None), ("*2..5", 2, 5)])
def test_hops(text, least, most):
    hop = parse(f"FROM a TRAVERSE -[:T{text}]-> b SELECT b.x").steps[0]
    assert (hop.path, hop.least, hop.most) == (True, least, most)


@pytest.mark.parametrize("arrow,way", [("-->", "out"), ("<--", "in"), ("-[:T]->", "out"), ("<-[:T]-", "in"), ("<-[:T]", "in"), ("<-[:T]->", "both"), ("-[:T]-", "both")])
def test_arrows(arrow, way):
    assert parse(f"FROM a TRAVERSE {arrow} b SELECT b.x").steps[0].direction == way


def test_precedence():
    e = parse("FROM a WHERE NOT x = 1 OR y + 2 * 3 < 7 AND z SELECT x").where
    assert e == n.Op("or", n.Not(n.Op("=", n.Prop(None, "x"), n.Lit(1))), n.Op("and", n.Op("<", n.Op("+", n.Prop(None, "y"), n.Op("*", n.Lit(2), n.Lit(3))), n.Lit(7)), n.Prop(None, "z")))


def test_star_and_chain():
    star = parse("FROM a TRAVERSE -[:T]-> b, -[:S]-> c SELECT *").steps
    chain = parse("FROM a TRAVERSE -[:T]-> b TRAVERSE -[:S]-> c SELECT *").steps
    assert [h.source for h in star] == ["a", "a"] and [h.source for h in chain] == ["a", "b"]


@pytest.mark.parametrize("text,lang", [("MATCH (a:B) RETURN a", "cypher"), ("with a as (select x from t) select x from a", "sql"), ("WITH a AS (FROM t SELECT x) FROM a SELECT x", "query"), ("CREATE (a:B {x: 1})", "cypher"), ("CREATE (1)-[:T]->(2)", "query"), ("DELETE FROM t", "query"), ("CREATE TABLE t (id INT)", "sql"), ("select x from t", "sql"), ("from t select x", "query")])
def test_language(text, lang):
    assert language(text) == lang
