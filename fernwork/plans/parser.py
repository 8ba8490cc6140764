"""Recursive-descent parsers: expressions, the FROM-first query language, and what SQL and Cypher share."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from fernwork.plans import nodes as n
from fernwork.plans.lexer import QuerySyntaxError, Token, tokenize

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE", "APPROX_COUNT_DISTINCT"}
#: Words that end a list of names where an alias could stand.
STOPS = {"TRAVERSE", "WHERE", "SELECT", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "SKIP", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ASOF", "SEMI", "ANTI", "ON", "SET", "VALUES", "UNION", "INTERSECT", "EXCEPT", "RETURN", "FROM", "AS", "WITH", "SHORTEST", "UPDATE", "CREATE", "OPTIMIZE", "CASCADE"}


class Parser:
    two_valued = True

    def __init__(self, text: str):
        self.tokens, self.at, self.made = tokenize(text), 0, 0

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.now
        self.at += token.kind != "end"
        return token

    def is_op(self, *texts: str) -> bool:
        return self.now.kind == "op" and self.now.text in texts

    def is_word(self, *words: str) -> bool:
        return self.now.upper in words

    def op(self, *texts: str) -> str | None:
        return self.take().text if self.is_op(*texts) else None

    def word(self, *words: str) -> str | None:
        return self.take().upper if self.is_word(*words) else None

    def need_op(self, text: str) -> None:
        if not self.op(text):
            self.fail(repr(text))

    def need_word(self, *words: str) -> str:
        return self.word(*words) or self.fail(" or ".join(words))

    def name(self) -> str:
        return self.take().text if self.now.kind == "name" else self.fail("a name")

    def integer(self) -> int:
        return int(self.take().text) if self.now.kind == "int" else self.fail("a whole number")

    def fail(self, wanted: str) -> Any:
        raise QuerySyntaxError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def fresh(self) -> str:
        self.made += 1
        return f"_b{self.made}"

    def listed(self, item) -> list:
        out = [item()]
        while self.op(","):
            out.append(item())
        return out

    def alias(self) -> str | None:
        if self.word("AS"):
            return self.name()
        return self.name() if self.now.kind == "name" and self.now.upper not in STOPS else None

    def end(self) -> None:
        self.op(";")
        if self.now.kind != "end":
            self.fail("the end")

    # expressions
    def expression(self) -> Any:
        left = self.conjunction()
        while self.word("OR"):
            left = n.Op("or", left, self.conjunction())
        return left

    def conjunction(self) -> Any:
        left = self.negation()
        while self.word("AND"):
            left = n.Op("and", left, self.negation())
        return left

    def negation(self) -> Any:
        return n.Not(self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> Any:
        left = self.sum()
        if op := self.op("=", "==", "!=", "<>", "<", "<=", ">", ">="):
            return n.Op({"==": "=", "<>": "!="}.get(op, op), left, self.sum())
        if self.word("IS"):
            no = bool(self.word("NOT"))
            self.need_word("NULL")
            return n.IsNull(left, no)
        no = self.is_word("NOT") and self.ahead().upper in ("IN", "LIKE", "BETWEEN") and bool(self.word("NOT"))
        if self.word("IN"):
            if self.at_query():
                return n.InQuery(left, self.subquery(), no)
            close = "]" if self.op("[") else ")" if self.op("(") else self.fail("a list")
            values = tuple(self.listed(self.sum))
            self.need_op(close)
            return n.In(left, values, no)
        found = None
        if self.word("LIKE"):
            found = n.Op("like", left, self.sum())
        elif self.word("BETWEEN"):
            low = self.sum()
            self.need_word("AND")
            found = n.Op("and", n.Op(">=", left, low), n.Op("<=", left, self.sum()))
        return left if found is None else n.Not(found) if no else found

    # queries inside expressions
    def at_query(self) -> bool:
        """Whether a query in brackets begins here."""
        return self.is_op("(") and self.ahead().upper in ("SELECT", "FROM", "WITH")

    def subquery(self) -> Any:
        self.need_op("(")
        out = self.query()
        self.need_op(")")
        return out

    def query(self) -> Any:
        """A query, with the tables that WITH names before it."""
        if not (self.is_word("WITH") and self.ahead(2).upper == "AS"):
            return self.plain_query()
        self.need_word("WITH")

        def table() -> tuple:
            name = self.name()
            self.need_word("AS")
            return name, self.subquery()

        return n.With(self.listed(table), self.plain_query())

    def plain_query(self) -> Any:
        return self.select()

    def sum(self) -> Any:
        left = self.product()
        while self.is_op("+", "-"):
            left = n.Op(self.take().text, left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while self.is_op("*", "/", "%"):
            left = n.Op(self.take().text, left, self.unary())
        return left

    def unary(self) -> Any:
        if self.op("-"):
            arg = self.unary()
            return n.Lit(-arg.value) if isinstance(arg, n.Lit) and isinstance(arg.value, (int, float)) else n.Neg(arg)
        return self.primary()

    def literal(self) -> n.Lit | None:
        kind, word = self.now.kind, self.now.upper
        if kind == "int":
            return n.Lit(int(self.take().text))
        if kind == "float":
            return n.Lit(float(self.take().text))
        if kind == "str":
            return n.Lit(self.take().text)
        if word in ("TRUE", "FALSE", "NULL") and not (self.ahead().kind == "op" and self.ahead().text == "."):
            self.take()
            return n.Lit({"TRUE": True, "FALSE": False, "NULL": None}[word])
        return None

    def value(self) -> Any:
        """A literal of a property map or a VALUES list."""
        minus = self.op("-")
        got = self.literal() or self.fail("a literal")
        return -got.value if minus else got.value

    def primary(self) -> Any:
        if (got := self.literal()) is not None:
            return got
        if self.at_query():
            return n.ScalarQuery(self.subquery())
        if self.op("("):
            inner = self.expression()
            self.need_op(")")
            return inner
        if self.is_word("EXISTS") and self.ahead().text == "(":
            self.take()
            return n.InQuery(None, self.subquery())
        if self.now.kind != "name":
            self.fail("an expression")
        if self.is_word("CASE"):
            return self.case()
        call = self.ahead().kind == "op" and self.ahead().text == "("
        if call and self.now.upper in AGGREGATES:
            return self.over(self.aggregate())
        first = self.name()
        if call:
            self.need_op("(")
            args = () if self.is_op(")") else tuple(self.listed(self.expression))
            self.need_op(")")
            return self.over(n.Func(first.lower(), args))
        if self.is_op(".") and (self.ahead().kind == "name" or self.ahead().text == "*"):
            self.take()
            return n.Star(first) if self.op("*") else n.Prop(first, self.name())
        return n.Prop(None, first)

    def over(self, call: n.Agg | n.Func) -> Any:
        """A call, or the window function that it is with OVER (PARTITION BY .. ORDER BY .. ROWS BETWEEN .. AND ..)."""
        if not (self.is_word("OVER") and self.ahead().text == "("):
            return call
        self.take(), self.need_op("(")
        partition: tuple = ()
        if self.word("PARTITION"):
            self.need_word("BY")
            partition = tuple(self.listed(self.expression))
        order: tuple = ()
        if self.word("ORDER"):
            self.need_word("BY")
            order = tuple(self.listed(self.order_key))
        frame = None
        if kind := self.word("ROWS", "RANGE"):
            between = bool(self.word("BETWEEN"))
            low = self.bound()
            high: int | None = 0
            if between:
                self.need_word("AND")
                high = self.bound()
            frame = (kind.lower(), low, high)
        self.need_op(")")
        args = call.args if isinstance(call, n.Func) else () if call.arg is None else (call.arg,)
        if getattr(call, "distinct", False):
            self.fail("a window function without DISTINCT")
        return n.Over(call.name, args, partition, order, frame)

    def bound(self) -> int | None:
        """An end of a frame, rows before counted as negative; None is open."""
        if self.word("UNBOUNDED"):
            self.need_word("PRECEDING", "FOLLOWING")
            return None
        if self.word("CURRENT"):
            self.need_word("ROW")
            return 0
        many = self.integer()
        return -many if self.need_word("PRECEDING", "FOLLOWING") == "PRECEDING" else many

    def order_key(self) -> tuple:
        e = self.expression()
        return e, self.word("ASC", "DESC") != "DESC"

    def aggregate(self) -> n.Agg:
        name = self.take().upper.lower()
        self.need_op("(")
        if self.op("*"):
            out = n.Agg(name)
        else:
            distinct = bool(self.word("DISTINCT"))
            out = n.Agg(name, self.expression(), distinct)
        self.need_op(")")
        return out

    def case(self) -> n.Case:
        self.need_word("CASE")
        branches = []
        while self.word("WHEN"):
            condition = self.expression()
            self.need_word("THEN")
            branches.append((condition, self.expression()))
        default = self.expression() if self.word("ELSE") else None
        self.need_word("END")
        return n.Case(tuple(branches), default)

    def items(self) -> list[n.Item]:
        def item() -> n.Item:
            if self.op("*"):
                return n.Item(n.Star())
            e = self.expression()
            return n.Item(e, self.name() if self.word("AS") else None)

        return self.listed(item)

    def tail(self, q: n.Select) -> n.Select:
        """GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET."""
        self.grouping(q)
        return self.paging(q)

    def grouping(self, q: n.Select) -> None:
        if self.word("GROUP"):
            self.need_word("BY")
            if self.is_word("GROUPING") and self.ahead().upper == "SETS":
                self.take(), self.take()
                self.need_op("(")

                def one() -> list:
                    if not self.op("("):
                        return [self.expression()]
                    out = [] if self.is_op(")") else self.listed(self.expression)
                    self.need_op(")")
                    return out

                q.cube, q.sets = "sets", self.listed(one)
                q.group = list(dict.fromkeys(e for x in q.sets for e in x))
                self.need_op(")")
            elif self.is_word("ROLLUP", "CUBE"):
                q.cube = self.take().upper.lower()
                self.need_op("(")
                q.group = self.listed(self.expression)
                self.need_op(")")
            else:
                q.group = self.listed(self.expression)
        if self.word("HAVING"):
            q.having = self.expression()

    def paging(self, q: n.Select) -> n.Select:
        if self.word("ORDER"):
            self.need_word("BY")
            q.order = self.listed(self.order_key)
        while self.is_word("LIMIT", "OFFSET", "SKIP"):
            if self.take().upper == "LIMIT":
                q.limit = self.integer()
            else:
                q.offset = self.integer()
        return q

    def properties(self) -> dict:
        """{name: literal, ...}"""
        self.need_op("{")
        out: dict = {}
        while not self.op("}"):
            key = self.take().text if self.now.kind in ("name", "str") else self.fail("a property name")
            self.need_op(":")
            out[key] = self.value()
            if not self.op(","):
                self.need_op("}")
                break
        return out

    def hops(self) -> tuple[bool, int, int | None]:
        """What stands after `*` in an edge pattern."""
        if not self.op("*"):
            return False, 1, 1
        if self.op(".."):
            return True, 1, self.integer()
        if self.now.kind != "int":
            return True, 1, None
        least = self.integer()
        if not self.op(".."):
            return True, least, least
        return True, least, self.integer() if self.now.kind == "int" else None

    def edge(self) -> dict:
        """`-[e:T|U *m..n]->`, `-->`, `<-[..]-`, `<--`, `<->`, `-[..]-`, `<-[..]->`; the closing dash may lack."""
        back = bool(self.op("<"))
        self.need_op("-")
        out: dict = {"types": (), "edge": None, "path": False, "least": 1, "most": 1}
        if self.op("["):
            if self.now.kind == "name":
                out["edge"] = self.name()
            if self.op(":"):
                types = [self.name()]
                while self.op("|"):
                    self.op(":")
                    types.append(self.name())
                out["types"] = tuple(types)
            out["path"], out["least"], out["most"] = self.hops()
            if self.is_op("{"):
                out["props"] = self.properties()
            self.need_op("]")
        closed = self.op("-")
        forward = bool(self.op(">"))
        if not forward and not back and not closed:
            self.fail("an arrow")
        out["direction"] = "both" if back == forward else "in" if back else "out"
        return out

    # statements
    def statement(self) -> Any:
        out = self.body()
        self.end()
        return out

    def body(self) -> Any:
        if self.is_word("FROM", "WITH"):
            return self.query()
        if self.word("INSERT"):
            return self.insert()
        if self.is_word("UPDATE"):
            return self.update()
        if self.is_word("DELETE"):
            return self.delete()
        if self.is_word("CREATE", "DROP"):
            return self.create()
        if action := self.word("BEGIN", "COMMIT", "ROLLBACK"):
            return self.transaction(action.lower())
        return self.fail("a statement")

    def transaction(self, action: str) -> n.Transaction:
        self.word("TRANSACTION")
        level = None
        if self.word("ISOLATION"):
            self.need_word("LEVEL")
            words = [self.name()]
            while self.now.kind == "name":
                words.append(self.name())
            level = " ".join(words).lower()
        return n.Transaction(action, level)

    def select(self) -> n.Select:
        self.need_word("FROM")
        name = self.name()
        q = n.Select(name, self.alias() or name, two_valued=self.two_valued)
        where = []
        last = q.alias
        while self.is_word("WHERE", "TRAVERSE"):
            if self.word("WHERE"):
                where.append(self.expression())
                continue
            self.need_word("TRAVERSE")
            # a list of patterns is a star around the first binding, a further TRAVERSE goes on from the last one
            centre = last
            for k, hop in enumerate(self.listed(lambda: self.pattern(q, centre))):
                centre = centre if k else hop.source
                last = hop.target
        for e in where:
            q.where = e if q.where is None else n.Op("and", q.where, e)
        if self.word("SHORTEST"):
            self.need_word("PATH")
            q.steps = [replace(x, shortest=True) if isinstance(x, n.Hop) and x.path else x for x in q.steps]
        if self.word("OPTIMIZE"):  # a hint for other engines; Catalyst plans
            self.need_word("WITH")
            self.expression()
        if self.is_word("UPDATE"):
            return self.update_from(q)
        if self.is_word("CREATE"):
            return self.create_from(q)
        self.grouping(q)
        self.need_word("SELECT")
        q.distinct = bool(self.word("DISTINCT"))
        q.items = self.items()
        return self.tail(q)

    def update_from(self, q: n.Select) -> n.UpdateFrom:
        """UPDATE binding {property: expression, ..}; without a binding it is the first one."""
        self.need_word("UPDATE")
        binding = q.alias if self.is_op("{") else self.name()
        self.need_op("{")

        def one() -> tuple:
            name = self.name()
            self.need_op(":")
            return name, self.expression()

        sets = tuple(self.listed(one))
        self.need_op("}")
        return n.UpdateFrom(q, binding, sets)

    def create_from(self, q: n.Select) -> n.CreateFrom:
        """CREATE (binding)-[:T]->(binding) {properties}"""
        self.need_word("CREATE")
        self.need_op("(")
        source = self.name()
        self.need_op(")")
        e = self.edge()
        self.need_op("(")
        target = self.name()
        self.need_op(")")
        if len(e["types"]) != 1 or e["direction"] == "both":
            self.fail("one edge type and a direction")
        ends = (source, target) if e["direction"] == "out" else (target, source)
        return n.CreateFrom(q, ends[0], e["types"][0], ends[1], self.properties() if self.is_op("{") else e.get("props", {}))

    def pattern(self, q: n.Select, centre: str) -> n.Hop:
        e = self.edge()
        e.pop("props", None)
        target, collection = self.fresh(), None
        if self.word("AS"):
            target = self.name()
        elif self.now.kind == "name" and self.now.upper not in STOPS:
            target = self.name()
            if self.op(":"):
                collection = self.name()
            elif self.word("AS"):
                collection, target = target, self.name()
        strength = None
        if self.is_word("WITH") and self.ahead().upper == "PHEROMONE":
            self.take(), self.take()
            self.word("STRENGTH")
            self.need_op(">")
            strength = self.value()
        elif self.is_word("WITH") and self.ahead().upper == "EXPLORE":  # a hint for other engines
            self.take(), self.take()
            self.need_word("RATE")
            self.value()
        hop = n.Hop(centre, target, collection=collection, strength=strength, **e)
        q.steps.append(hop)
        return hop

    def insert(self) -> n.Insert:
        self.need_word("INTO")
        name = self.name()
        columns: tuple = ()
        if self.op("("):
            columns = tuple(self.listed(self.name))
            self.need_op(")")
        self.need_word("VALUES")

        def row() -> tuple:
            self.need_op("(")
            if self.is_op("{"):
                out: Any = self.properties()
            else:
                out = tuple(self.listed(self.value))
            self.need_op(")")
            return out

        return n.Insert(name, tuple(self.listed(row)), columns)

    def update(self) -> n.Update:
        self.need_word("UPDATE")
        name = self.name()
        self.need_word("SET")

        def one() -> tuple:
            column = self.name()
            self.need_op("=")
            return column, self.sum()

        sets = tuple(self.listed(one))
        return n.Update(name, sets, self.expression() if self.word("WHERE") else None, self.two_valued)

    def delete(self) -> n.Delete:
        self.need_word("DELETE")
        self.need_word("FROM")
        name = self.name()
        return n.Delete(name, self.expression() if self.word("WHERE") else None, self.two_valued, bool(self.word("CASCADE")))

    def create(self) -> Any:
        if self.word("DROP"):
            self.need_word("INDEX")
            return n.DropIndex(self.name())
        self.need_word("CREATE")
        unique = bool(self.word("UNIQUE"))
        if self.word("INDEX"):
            name = self.name()
            self.need_word("ON")
            collection = self.name()
            self.need_op("(")
            column = self.name()
            self.need_op(")")
            return n.CreateIndex(name, collection, column, unique)
        if self.word("TABLE"):
            return self.create_table()
        if self.now.kind == "name":
            return n.Insert(self.name(), (self.properties(),))
        self.need_op("(")
        source = self.expression()
        self.need_op(")")
        e = self.edge()
        self.need_op("(")
        target = self.expression()
        self.need_op(")")
        if len(e["types"]) != 1 or e["direction"] == "both":
            self.fail("one edge type and a direction")
        ends = (source, target) if e["direction"] == "out" else (target, source)
        return n.CreateEdge(ends[0], e["types"][0], ends[1], self.properties() if self.is_op("{") else e.get("props", {}))

    def create_table(self) -> n.CreateTable:
        if self.word("IF"):
            self.need_word("NOT"), self.need_word("EXISTS")
        name = self.name()
        self.need_op("(")

        def column() -> tuple:
            column, kind = self.name(), self.name().upper()
            if self.op("("):
                self.integer(), self.need_op(")")
            rules: dict = {}
            while self.now.kind == "name":
                if self.word("NOT"):
                    self.need_word("NULL")
                    rules["required"] = True
                elif self.word("NULL"):
                    pass
                elif self.word("UNIQUE"):
                    rules["unique"] = True
                elif self.word("PRIMARY"):
                    self.need_word("KEY")
                    rules["primary"] = True
                elif self.word("DEFAULT"):
                    rules["default"] = self.value()
                elif self.word("CHECK"):
                    self.need_op("(")
                    rules["check"] = self.expression()
                    self.need_op(")")
                else:
                    self.fail("a constraint")
            return column, kind, rules

        columns = tuple(self.listed(column))
        self.need_op(")")
        return n.CreateTable(name, columns)


class SqlParser(Parser):
    two_valued = False

    def body(self) -> Any:
        return self.query() if self.is_word("SELECT", "WITH") or self.is_op("(") else super().body()

    def plain_query(self) -> Any:
        return self.union()

    def union(self) -> Any:
        left = self.intersection()
        while self.is_word("UNION", "EXCEPT"):
            kind = self.take().upper.lower()
            kind += " all" if self.word("ALL") else ""
            left = n.SetOp(kind, left, self.intersection())
        return left

    def intersection(self) -> Any:
        left = self.block()
        while self.word("INTERSECT"):
            left = n.SetOp("intersect all" if self.word("ALL") else "intersect", left, self.block())
        return left

    def block(self) -> Any:
        if self.op("("):
            inner = self.union()
            self.need_op(")")
            return inner
        self.need_word("SELECT")
        distinct = bool(self.word("DISTINCT"))
        items = self.items()
        self.need_word("FROM")
        name = self.name()
        q = n.Select(name, self.alias() or name, items=items, distinct=distinct, two_valued=False)
        while self.is_word("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ASOF"):
            kind = "inner" if self.is_word("JOIN") else self.take().upper.lower()
            if kind == "asof" and self.word("LEFT"):
                kind = "asof_left"
            if self.is_word("SEMI", "ANTI"):
                kind = f"{kind}_{self.take().upper.lower()}"
            self.word("OUTER")
            self.need_word("JOIN")
            table = self.name()
            alias = self.alias() or table
            q.steps.append(n.JoinStep(table, alias, kind, self.expression() if self.word("ON") else None))
        if self.word("WHERE"):
            q.where = self.expression()
        return self.tail(q)


class CypherParser(Parser):
    two_valued = False

    def body(self) -> Any:
        if self.word("MATCH"):
            return self.match()
        if self.word("CREATE"):
            nodes, edges, _, _ = self.paths()
            return n.CreateGraph(tuple(nodes), tuple(edges))
        return self.fail("MATCH or CREATE")

    def node(self) -> tuple:
        self.need_op("(")
        var = self.name() if self.now.kind == "name" else self.fresh()
        label = self.name() if self.op(":") else None
        props = self.properties() if self.is_op("{") else {}
        self.need_op(")")
        return var, label, props

    def paths(self) -> tuple:
        """Comma-separated chains: nodes (first mentions), edges for CREATE, hops for MATCH, property conditions."""
        nodes: dict = {}
        edges, hops, conditions = [], [], []

        def node() -> str:
            var, label, props = self.node()
            if var not in nodes:
                nodes[var] = (var, label, props)
            elif label and not nodes[var][1]:
                nodes[var] = (var, label, nodes[var][2])
            conditions.extend(n.Op("=", n.Prop(var, k), n.Lit(v)) for k, v in props.items())
            return var

        while True:
            here = node()
            while self.is_op("-", "<"):
                e = self.edge()
                props = e.pop("props", {})
                there = node()
                if props:
                    e["edge"] = e["edge"] or self.fresh()
                    conditions.extend(n.Op("=", n.Prop(e["edge"], k), n.Lit(v)) for k, v in props.items())
                hops.append(n.Hop(here, there, collection=nodes[there][1], **e))
                a, b = (there, here) if e["direction"] == "in" else (here, there)
                edges.append((a, e["types"][0] if e["types"] else None, b, props))
                here = there
            if not self.op(","):
                return list(nodes.values()), edges, hops, conditions

    def match(self) -> n.Select:
        nodes, _, hops, conditions = self.paths()
        first = next((x for x in nodes if x[0] == hops[0].source), nodes[0]) if hops else nodes[0]
        if first[1] is None:
            self.fail("a label for the first node")
        where = None
        if self.word("WHERE"):
            where = self.expression()
        for c in conditions:
            where = c if where is None else n.Op("and", where, c)
        self.need_word("RETURN")
        q = n.Select(first[1], first[0], steps=list(hops), where=where, two_valued=False, strict=True)
        q.distinct = bool(self.word("DISTINCT"))
        variables = {v for v, _, _ in nodes}

        def named(item: n.Item) -> n.Item:
            e = item.expr
            if isinstance(e, n.Prop) and e.binding is None and e.name in variables:
                return n.Item(n.Func("entity", (n.Star(e.name),)), item.name or e.name)
            return item if item.name or not isinstance(e, n.Prop) else n.Item(e, f"{e.binding}.{e.name}")

        q.items = [named(x) for x in self.items()]
        if any(isinstance(x, n.Agg) for i in q.items for x in n.walk(i.expr)):
            q.group = [i.expr for i in q.items if not any(isinstance(x, n.Agg) for x in n.walk(i.expr))]
        return self.paging(q)


def language(text: str) -> str:
    """sql, cypher or query (FROM first), by the first two words."""
    words = [t.upper or t.text for t in tokenize(text)[:5]]
    if words[0] == "WITH":  # WITH name AS ( ..
        return "sql" if words[4:] == ["SELECT"] else "query"
    if words[0] == "MATCH":
        return "cypher"
    if words[0] == "SELECT" or words[:2] in (["CREATE", "TABLE"],) or words[0] == "(":
        return "sql"
    if words[0] == "CREATE" and words[1] == "(":
        rest = tokenize(text)
        return "cypher" if any(t.kind == "op" and t.text == ":" for t in rest[2:4]) else "query"
    return "query"


def parse(text: str, lang: str | None = None) -> Any:
    kind = {"sql": SqlParser, "cypher": CypherParser, "query": Parser}[lang or language(text)]
    return kind(text).statement()
