"""Logical plan to a lazy DataFrame; Catalyst does the rest.

Every binding's properties are columns `binding__property` of one wide row, so rows of source, edge and target stay
together, and pruning drops what isn't asked for. A condition is applied as soon as its bindings are there; that
matters for paths of variable length, which Catalyst can't push a filter through.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwork.functions.expressions import Expressions, QueryError
from fernwork.operators import joins, paths
from fernwork.operators.catalog import Catalog, EdgeType
from fernwork.plans import nodes as n

DEPTH = "depth"


def column(binding: str, name: str) -> str:
    return f"{binding}__{name}"


class Rows:
    """A table of bindings while a query is put together."""

    def __init__(self, catalog: Catalog, q: n.Select):
        self.catalog, self.q = catalog, q
        first = catalog.collection(q.collection)
        self.bindings: dict[str, list[str]] = {}
        self.kinds = {q.alias: first.name}  # collection of each vertex binding; None if it may be of several
        self.df = self.bound(first.df, q.alias)
        self.walked: dict[str, str] = {}  # binding at the end of a path to the path's own
        self.scalars: dict[Any, Column] = {}
        self.queries = 0
        self.types: dict[Any, Any] = {}
        self.open = n.conjuncts(q.where)
        outer = any(isinstance(s, n.JoinStep) and s.kind in ("left", "right", "full", "left_outer", "asof_left") for s in q.steps)
        later = self.open if outer else []
        self.open = [] if outer else self.open
        self.settle()
        for step in q.steps:
            self.hop(step) if isinstance(step, n.Hop) else self.join(step)
            self.settle()
        self.open += later
        self.settle(last=True)

    def bound(self, df: DataFrame, binding: str) -> DataFrame:
        self.bindings[binding] = df.columns
        return df.select([F.col(f"`{c}`").alias(column(binding, c)) for c in df.columns])

    def resolve(self, p: n.Prop) -> Column:
        if p.binding is not None:
            if p.binding not in self.bindings:
                raise QueryError(f"no binding {p.binding}")
            if p.name in (DEPTH, "path") and p.name not in self.bindings[p.binding] and p.binding in self.walked:
                return F.col(f"`{column(self.walked[p.binding], p.name)}`")
            if p.name not in self.bindings[p.binding]:
                raise QueryError(f"{p.binding} has no property {p.name}")
            return F.col(f"`{column(p.binding, p.name)}`")
        for b, names in self.bindings.items():
            if p.name in names:
                return F.col(f"`{column(b, p.name)}`")
        if p.name == "PATH":
            return self.resolve(n.Prop(None, "path"))
        raise QueryError(f"no property {p.name}")

    def kind(self, c: Column) -> Any:
        """A column's type; asked once for each."""
        key = str(c)
        if key not in self.types:
            self.types[key] = self.df.select(c).schema[0].dataType
        return self.types[key]

    def entity(self, binding: str) -> Column:
        return F.struct(*[F.col(f"`{column(binding, c)}`").alias(c) for c in self.bindings[binding]])

    def expressions(self, known: dict | None = None) -> Expressions:
        return Expressions(self.resolve, self.q.two_valued, {**self.scalars, **(known or {})}, self.entity, self.kind, self.q.strict)

    def add_scalars(self, *found: Any) -> None:
        """Values of queries inside expressions, as columns: each is one row, which is broadcast."""
        for e in (x for f in found if f is not None for x in n.walk(f)):
            if isinstance(e, n.ScalarQuery) and e not in self.scalars:
                self.queries += 1
                name = f"_s{self.queries}"
                self.df = self.df.join(F.broadcast(one_value(self.catalog, e.query, name)))
                self.scalars[e] = F.col(name)

    def within(self, e: n.InQuery, negated: bool) -> None:
        """IN or EXISTS as a semi or anti join. A condition of the inner query that speaks of outer bindings joins."""
        self.queries += 1
        mark, inner, on = f"_q{self.queries}_", e.query, F.lit(True)
        if isinstance(inner, n.Select) and not (inner.group or inner.limit is not None or inner.offset or any(isinstance(x, n.Agg) for i in inner.items for x in n.walk(i.expr))):
            mine, outer = [], []
            probe = Rows(self.catalog, replace(inner, where=None))
            for c in n.conjuncts(inner.where):
                props = [x for x in n.walk(c) if isinstance(x, n.Prop)]
                (mine if all(probe.has(p) for p in props) else outer).append(c)
            rows = Rows(self.catalog, replace(inner, where=n.joined(mine)))
            if e.arg is not None:
                items = named_items(rows, inner)
                if len(items) != 1:
                    raise QueryError("IN needs a query of one column")
                rows.df = rows.df.withColumn("_in", rows.expressions().value(items[0][0]))
            held = rows.df.select([F.col(f"`{c}`").alias(mark + c) for c in rows.df.columns])

            def either(p: n.Prop) -> Column:
                return F.col(f"`{mark}{rows.place(p)}`") if rows.has(p) else self.resolve(p)

            joint = self.df.limit(0).join(held.limit(0))
            ex = Expressions(either, self.q.two_valued, kind=lambda c: joint.select(c).schema[0].dataType, strict=self.q.strict)
            for c in outer:
                on = on & ex.condition(c)
        else:
            if e.arg is None:
                held = compile_query(self.catalog, inner)
                held = held.toDF(*[f"{mark}{k}" for k in range(len(held.columns))])
            else:
                held = compile_query(self.catalog, inner).toDF(f"{mark}_in")
            outer = []
        if e.arg is None:
            if not outer:  # whether there is any row at all
                some = held.limit(1).agg(F.count(F.lit(1)).alias(mark))
                self.df = self.df.join(F.broadcast(some)).where((F.col(mark) == 0) if negated else (F.col(mark) > 0)).drop(mark)
            else:
                self.df = self.df.join(held, on, "left_anti" if negated else "left_semi")
            return
        arg, value = self.expressions().value(e.arg), F.col(f"`{mark}_in`")
        if self.q.two_valued:
            self.df = self.df.join(held, on & arg.eqNullSafe(value), "left_anti" if negated else "left_semi")
        elif not negated:
            self.df = self.df.join(held, on & (arg == value), "left_semi")
        elif outer:
            self.df = self.df.join(held, on & ((arg == value) | arg.isNull() | value.isNull()), "left_anti")
        else:  # a null among the values, or on the left beside any values, leaves NOT IN unknown
            size = held.agg(F.count(F.lit(1)).alias(f"{mark}n"), F.count(value).alias(f"{mark}m"))
            left = self.df.join(F.broadcast(size)).where((F.col(f"{mark}n") == 0) | ((F.col(f"{mark}n") == F.col(f"{mark}m")) & arg.isNotNull()))
            self.df = left.join(held, arg == value, "left_anti").drop(f"{mark}n", f"{mark}m")

    def has(self, p: n.Prop) -> bool:
        return p.name in self.bindings.get(p.binding, ()) if p.binding is not None else any(p.name in x for x in self.bindings.values())

    def place(self, p: n.Prop) -> str:
        return column(p.binding if p.binding is not None else next(b for b, x in self.bindings.items() if p.name in x), p.name)

    def settle(self, last: bool = False) -> None:
        """Applies the conditions all of whose properties are there."""
        waiting = []
        for e in self.open:
            try:
                negated, inner = False, e
                while isinstance(inner, n.Not):
                    negated, inner = not negated, inner.arg
                if isinstance(inner, n.InQuery):
                    self.within(inner, inner.negated != negated)
                    continue
                self.add_scalars(e)
                self.df = self.df.where(self.expressions().condition(e))
            except QueryError:
                if last:
                    raise
                waiting.append(e)
        self.open = waiting

    def join(self, step: n.JoinStep) -> None:
        right = self.catalog.collection(step.collection)
        kept = dict(self.bindings)
        other = self.bound(right.df, step.alias)
        if step.kind == "cross":
            self.df = self.df.crossJoin(other)
            self.kinds[step.alias] = right.name
            return
        if step.on is None:
            raise QueryError("a join needs a condition, or CROSS")
        how = {"left": "left", "right": "right", "full": "full"}.get(step.kind, step.kind)
        if step.kind.startswith("asof"):
            self.as_of(step, other)
            self.kinds[step.alias] = right.name
            return
        joint = self.df.limit(0).join(other.limit(0))
        on = Expressions(self.resolve, self.q.two_valued, self.scalars, self.entity, lambda c: joint.select(c).schema[0].dataType, self.q.strict).condition(step.on)
        self.df = self.df.join(other, on, how)
        if how.endswith(("semi", "anti")):
            self.bindings = kept
        else:
            self.kinds[step.alias] = right.name

    def as_of(self, step: n.JoinStep, other: DataFrame) -> None:
        """ASOF [LEFT] JOIN t ON a.k = t.k AND a.time >= t.time: the latest row of t that isn't later."""
        ends = {}
        for c in n.conjuncts(step.on):
            if not (isinstance(c, n.Op) and c.op in ("=", ">=", "<=") and isinstance(c.left, n.Prop) and isinstance(c.right, n.Prop)):
                raise QueryError("an as-of join is on one equality and one order of two properties")
            mine, its = (c.right, c.left) if c.left.binding == step.alias else (c.left, c.right)
            if c.op != "=" and (c.op == ">=") != (mine is c.left):
                raise QueryError("an as-of join looks back: the joined side isn't later")
            ends["by" if c.op == "=" else "at"] = (self.place(mine), column(step.alias, its.name))
        if ends.keys() != {"by", "at"} or len(n.conjuncts(step.on)) != 2:
            raise QueryError("an as-of join is on one equality and one order of two properties")
        (by, its_by), (at, its_at) = ends["by"], ends["at"]
        marks = other.withColumns({f"_{by}": F.col(f"`{its_by}`"), f"_{at}": F.col(f"`{its_at}`")})
        values = other.columns
        left = self.df.withColumnsRenamed({by: f"_{by}", at: f"_{at}"})
        self.df = joins.as_of(left, marks, f"_{by}", f"_{at}", values).withColumnsRenamed({f"_{by}": by, f"_{at}": at})
        if step.kind == "asof":
            self.df = self.df.where(F.col(f"`{its_by}`").isNotNull())

    def hop(self, h: n.Hop) -> None:
        if h.source not in self.kinds:
            raise QueryError(f"no binding {h.source}")
        if h.target in self.kinds:
            return self.close(h)
        name = self.kinds[h.source]
        walked = self.catalog.leaving(name, h.types, h.direction)
        target = self.catalog.collection(h.collection).name if h.collection else self.catalog.collection(h.target).name if self.catalog.has(h.target) else None
        if target:
            walked = [w for w in walked if h.path or (w[0].source_collection if w[1] else w[0].target_collection) == target]
        if not walked:
            raise QueryError(f"no edge {'|'.join(h.types)} goes {h.direction} from {name}")
        if len(walked) == 1 and not (h.path or h.edge or h.strength is not None) and self.by_key(h, *walked[0]):
            return None
        before, parts, found = dict(self.bindings), [], set()
        for reached, edges in self.edge_tables(walked, h).items():
            if h.path and target and reached != target:
                continue
            self.bindings = dict(before)
            parts.append(self.reach(h, edges, reached, name))
            found.add(reached)
        self.df = parts[0][0]
        self.bindings = dict(parts[0][1])
        for df, bindings in parts[1:]:
            self.df = self.df.unionByName(df, allowMissingColumns=True)
            for b, names in bindings.items():
                self.bindings[b] = [*self.bindings.get(b, []), *(c for c in names if c not in self.bindings.get(b, []))]
        if len(found) == 1:
            self.kinds[h.target] = found.pop()
        else:
            self.kinds[h.target] = ""  # of several collections: no further hop

    def by_key(self, h: n.Hop, e: EdgeType, against: bool) -> bool:
        """A hop along a foreign key: the target is joined on the key itself."""
        held = self.catalog.foreign_key(e)
        if held is None:
            return False
        here, there = (e.target_collection, e.source_collection) if against else (e.source_collection, e.target_collection)
        mine = (held[0] == "target") == against  # whether the rows that we come from hold the key
        left, right = self.catalog.collection(here), self.catalog.collection(there)
        a, b = (held[1], right.key) if mine else (left.key, held[1])
        if a not in self.bindings[h.source] or b not in right.df.columns:
            return False
        self.df = self.df.join(self.bound(right.df, h.target), F.col(f"`{column(h.source, a)}`") == F.col(f"`{column(h.target, b)}`"))
        self.kinds[h.target] = right.name
        return True

    def edge_tables(self, walked: list[tuple[EdgeType, bool]], h: n.Hop) -> dict[str, DataFrame]:
        """By collection that is reached: (_src, _dst, properties) in walking direction."""
        out: dict[str, DataFrame] = {}
        for e, against in walked:
            df = e.ends()
            if h.strength is not None:
                if "pheromone" not in df.columns:
                    raise QueryError(f"{e.name} has no pheromone")
                df = df.where(F.col("pheromone") > h.strength)
            if not h.edge:
                df = df.select("_src", "_dst")
            elif len(walked) > 1:
                df = df.withColumn("_type", F.lit(e.name))
            if against:
                rest = [c for c in df.columns if c not in ("_src", "_dst")]
                df = df.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst"), *rest)
            reached = e.source_collection if against else e.target_collection
            out[reached] = out[reached].unionByName(df, allowMissingColumns=True) if reached in out else df
        return out

    def reach(self, h: n.Hop, edges: DataFrame, reached: str, name: str) -> tuple[DataFrame, dict]:
        c, source = self.catalog.collection(reached), self.catalog.collection(name)
        if source.key is None or c.key is None:
            raise QueryError("a traversal needs collections with keys")
        key = F.col(f"`{column(h.source, source.key)}`")
        if h.path:
            if reached != name:
                raise QueryError("a path of several hops stays in one collection")
            starts = self.df.select(key.alias("_src")).distinct()
            if h.shortest:
                edges = paths.shortest_paths(starts, edges, h.most).where(F.col(DEPTH) >= h.least).where("_src <> _dst")
                names = [DEPTH, "path"]
            else:
                edges = paths.reachable(starts, edges, h.least, h.most)
                names = [DEPTH]
        else:
            names = [x for x in edges.columns if x not in ("_src", "_dst")] if h.edge else []
        edge = h.edge or f"_e_{h.target}"
        if names:
            self.bindings[edge] = names
        if h.path:
            self.walked[h.target] = edge
        e = edges.select(F.col("_src").alias("_s"), F.col("_dst").alias("_d"), *[F.col(f"`{x}`").alias(column(edge, x)) for x in names])
        met = self.df.join(e, key == F.col("_s")).drop("_s")
        met = met.join(self.bound(c.df, h.target), F.col("_d") == F.col(f"`{column(h.target, c.key)}`")).drop("_d")
        return met, dict(self.bindings)

    def close(self, h: n.Hop) -> None:
        """A hop between two bindings that are there already."""
        inner = replace(h, target=f"_c_{h.target}_{len(self.bindings)}", collection=self.kinds[h.target])
        self.hop(inner)
        key = self.catalog.collection(self.kinds[h.target]).key
        self.df = self.df.where(F.col(f"`{column(h.target, key)}`") == F.col(f"`{column(inner.target, key)}`"))


def named_items(rows: Rows, q: n.Select) -> list[tuple[Any, str]]:
    """(expression, output name); stars are spread, and a name that comes twice gets its binding before it."""
    out: list[tuple[Any, str]] = []
    aggregates = 0
    for k, item in enumerate(q.items):
        e = item.expr
        if isinstance(e, n.Star):
            for b, names in rows.bindings.items():
                if e.binding in (None, b) and not (e.binding is None and b.startswith("_")):
                    out += [(n.Prop(b, c), c if (c not in {x for _, x in out}) else f"{b}_{c}") for c in names]
            continue
        name = item.name
        if name is None:
            if isinstance(e, n.Prop):
                name = e.name if e.name not in {x for _, x in out} or e.binding is None else f"{e.binding}_{e.name}"
            elif isinstance(e, n.Agg):
                name = f"agg_{aggregates}"
            else:
                name = f"col_{k}"
        aggregates += isinstance(e, n.Agg)
        out.append((e, name))
    return out


def ordered(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """Nulls come last in either direction."""
    return df.orderBy(*[c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in keys]) if keys else df


def compile_select(catalog: Catalog, q: n.Select) -> DataFrame:
    rows = Rows(catalog, q)
    items = named_items(rows, q)
    by_name = {name: e for e, name in items}
    named = lambda e: by_name.get(e.name, e) if isinstance(e, n.Prop) and e.binding is None else e
    asked = [e for e, _ in items] + ([q.having] if q.having is not None else []) + [named(e) for e, _ in q.order]
    rows.add_scalars(*asked, *q.group)
    aggregates = list(dict.fromkeys(x for e in asked for x in n.walk(e) if isinstance(x, n.Agg)))
    df = rows.df
    if aggregates or q.group:
        ex = rows.expressions()
        groups = [named(g) for g in q.group]
        keys = [ex.value(g).alias(f"_k{k}") for k, g in enumerate(groups)]
        values = [ex.aggregate(a).alias(f"_a{k}") for k, a in enumerate(aggregates)]
        # values of queries are the same in every row
        values += [F.first(c).alias(f"_c{k}") for k, c in enumerate(rows.scalars.values())]
        sets = [[F.col(f"_k{groups.index(named(e))}") for e in x] for x in q.sets]
        grouped = df.withColumns({f"_k{k}": ex.value(g) for k, g in enumerate(groups)}).groupingSets(sets, *[F.col(f"_k{k}") for k in range(len(groups))]) if q.cube == "sets" else df.rollup(*keys) if q.cube == "rollup" else df.cube(*keys) if q.cube == "cube" else df.groupBy(*keys)
        df = grouped.agg(*values) if values else df.select(*keys).distinct()
        known: dict = {a: F.col(f"_a{k}") for k, a in enumerate(aggregates)} | {e: F.col(f"_c{k}") for k, e in enumerate(rows.scalars)}
        for k, g in enumerate(groups):
            known[g] = F.col(f"_k{k}")
            if isinstance(g, n.Prop):  # u.city and city are one key
                known[n.Prop(None, g.name)] = F.col(f"_k{k}")
                known |= {n.Prop(b, g.name): F.col(f"_k{k}") for b, names in rows.bindings.items() if g.name in names and g.binding in (None, b)}
        grouped_df = df
        out = Expressions(no_such, q.two_valued, known, kind=lambda c: grouped_df.select(c).schema[0].dataType, strict=q.strict)
        if q.having is not None:
            df = df.where(out.condition(having_names(q.having, by_name)))
    else:
        out = rows.expressions()
    shown = [out.value(e).alias(name) for e, name in items]
    order = [(out.value(named(e)).alias(f"_o{k}"), up) for k, (e, up) in enumerate(q.order)]
    df = df.select(*shown, *(c for c, _ in order)) if not q.distinct else df.select(*shown).distinct()
    if q.distinct and order:
        names = {e: name for e, name in items}
        df = ordered(df, [(F.col(f"`{names.get(named(e), getattr(e, 'name', ''))}`"), up) for e, up in q.order])
    else:
        df = ordered(df, [(F.col(f"_o{k}"), up) for k, (_, up) in enumerate(order)])
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.drop(*[f"_o{k}" for k in range(len(order))])


def having_names(e: Any, by_name: dict) -> Any:
    """HAVING may use the names of SELECT."""
    if isinstance(e, n.Prop) and e.binding is None and isinstance(by_name.get(e.name), (n.Agg, n.Op)):
        return by_name[e.name]
    if isinstance(e, n.Op):
        return n.Op(e.op, having_names(e.left, by_name), having_names(e.right, by_name))
    return n.Not(having_names(e.arg, by_name)) if isinstance(e, n.Not) else e


def no_such(p: n.Prop) -> Column:
    raise QueryError(f"{p.name} is neither grouped nor aggregated")


def compile_query(catalog: Catalog, q: Any) -> DataFrame:
    if isinstance(q, n.With):
        inner = catalog.copy()
        for name, table in q.tables:
            for k in [k for k in inner.collections if k.lower() == name.lower()]:
                del inner.collections[k]
            inner.add(name, compile_query(inner, table))
        return compile_query(inner, q.body)
    if isinstance(q, n.Select):
        return compile_select(catalog, q)
    left, right = compile_query(catalog, q.left), compile_query(catalog, q.right)
    if q.kind == "union":
        return left.union(right).distinct()
    return {"union all": left.union, "intersect": left.intersect, "intersect all": left.intersectAll, "except": left.subtract, "except all": left.exceptAll}[q.kind](right)


def one_value(catalog: Catalog, q: Any, name: str) -> DataFrame:
    """A query's only value as a table of one row; null without rows, an error with more than one."""
    df = compile_query(catalog, q)
    if len(df.columns) != 1:
        raise QueryError("a query that stands for a value needs one column")
    two = df.toDF(name).limit(2).agg(F.first(name).alias(name), F.count(F.lit(1)).alias("_n"))
    return two.select(F.when(F.col("_n") > 1, F.raise_error(F.lit("a query that stands for a value has more than one row"))).otherwise(F.col(name)).alias(name))


def reached(catalog: Catalog, q: n.Select, *bindings: str) -> tuple[DataFrame, list[str]]:
    """The different keys of some bindings' rows in a query's matches, as columns _0, _1, .., and their collections."""
    rows = Rows(catalog, q)
    names = [rows.kinds.get(b) for b in bindings]
    for b, name in zip(bindings, names, strict=True):
        if not name:
            raise QueryError(f"no rows of one collection bound to {b}")
    keys = [catalog.collection(x).key for x in names]
    if None in keys:
        raise QueryError("a collection without a key can't be changed by a traversal")
    return rows.df.select(*[F.col(f"`{column(b, k)}`").alias(f"_{i}") for i, (b, k) in enumerate(zip(bindings, keys, strict=True))]).distinct(), names
