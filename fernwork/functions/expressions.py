"""Expressions to columns.

Two-valued mode (the FROM-first language): `=` is null-safe, `!=` its negation, an ordering with a null is false,
and NOT negates that. Conditions are written so that Parquet filters still see plain comparisons: NOT is pushed
down to the comparisons, where `NOT a < b` becomes `a >= b OR a IS NULL OR b IS NULL`; in a positive place a null
result filters like false. Three-valued mode (SQL, Cypher) is Spark's own.

Values of different types: in the FROM-first language they are unequal (two nulls are equal) and in no order. SQL
turns a column's values into the other side's type, and those that can't be turned match nothing. In Cypher they
are unequal and in no order. Numbers of different types compare as numbers, strings beside dates as dates.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fernwork.functions.scalars import SCALARS, WINDOWS
from fernwork.plans import nodes as n

Resolve = Callable[[n.Prop], Column]
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_REVERSE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}
_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), "%": F.try_mod,
}


class QueryError(ValueError):
    pass


class Expressions:
    """resolve finds a property's column; known maps whole subexpressions to columns (aggregates, group keys); kind
    tells a column's type, so that arithmetic on strings and booleans gives null (in SQL: on what is no number)."""

    def __init__(self, resolve: Resolve, two_valued: bool, known: dict[Any, Column] | None = None, entity: Callable[[str], Column] | None = None, kind: Callable[[Column], T.DataType] | None = None, strict: bool = False):
        self.resolve, self.two_valued, self.known, self.entity, self.kind, self.strict = resolve, two_valued, known or {}, entity, kind, strict

    def family(self, e: Any, x: Column) -> tuple[str, T.DataType | None]:
        """What an expression's values can be compared with: number, string, bool, time, null, or any (not known)."""
        if isinstance(e, n.Lit):
            v = e.value
            return ("null" if v is None else "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"), None
        if self.kind is None:
            return "any", None
        t = self.kind(x)
        if isinstance(t, T.NullType):
            return "null", t
        if isinstance(t, T.NumericType):
            return "number", t
        if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
            return "string", t
        return ("bool" if isinstance(t, T.BooleanType) else "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "any"), t

    def sides(self, e: n.Op) -> tuple[Column, Column, bool]:
        """The two sides of a comparison, made comparable where the rules say so, and whether they are."""
        a, b = self.value(e.left), self.value(e.right)
        if isinstance(e.left, n.Lit) and isinstance(e.right, n.Lit) and type(e.left.value) is type(e.right.value):
            return a, b, True
        (fa, ta), (fb, tb) = self.family(e.left, a), self.family(e.right, b)
        if fa == fb or "any" in (fa, fb) or "null" in (fa, fb):
            return a, b, not (self.two_valued and fa == fb == "bool" and e.op in _REVERSE)
        if {fa, fb} == {"string", "time"}:
            return (a.try_cast(tb) if fa == "string" and tb is not None else a), (b.try_cast(ta) if fb == "string" and ta is not None else b), True
        if self.two_valued or self.strict:
            return a, b, False
        turn = {"number": "double", "string": "string", "bool": "boolean", "time": "timestamp"}
        if isinstance(e.left, n.Lit) and not isinstance(e.right, n.Lit):
            return a, b.try_cast(turn[fa]), True
        if isinstance(e.right, n.Lit):
            return a.try_cast(turn[fb]), b, True
        to = turn["number" if "number" in (fa, fb) else fb]
        return a.try_cast(to), b.try_cast(to), True

    def number(self, e: Any) -> Column:
        x = self.value(e)
        if self.kind is None or isinstance(e, n.Lit) and not isinstance(e.value, (str, bool)):
            return x
        t = self.kind(x)
        if isinstance(t, T.BooleanType) or isinstance(t, T.StringType) and self.two_valued:
            return F.lit(None).cast("double")
        return x.try_cast("double") if isinstance(t, T.StringType) else x

    def value(self, e: Any) -> Column:
        if (hit := self.known.get(e)) is not None:
            return hit
        if isinstance(e, n.Lit):
            return F.lit(e.value)
        if isinstance(e, n.Prop):
            return self.resolve(e)
        if isinstance(e, n.Neg):
            return F.negative(self.value(e.arg))
        if isinstance(e, n.Op) and e.op in _ARITHMETIC:
            return _ARITHMETIC[e.op](self.number(e.left), self.number(e.right))
        if isinstance(e, n.Agg):
            return self.aggregate(e)
        if isinstance(e, n.Over):
            return self.over(e)
        if isinstance(e, n.Case):
            out = None
            for condition, value in e.branches:
                c, v = self.condition(condition), self.value(value)
                out = F.when(c, v) if out is None else out.when(c, v)
            return out if e.default is None else out.otherwise(self.value(e.default))
        if isinstance(e, n.Func):
            return self.call(e)
        if isinstance(e, (n.Op, n.Not, n.IsNull, n.In, n.InQuery)):
            c = self.condition(e)
            return F.coalesce(c, F.lit(False)) if self.two_valued else c
        raise QueryError(f"{e} has no value")

    def call(self, e: n.Func) -> Column:
        if e.name == "entity" and self.entity:
            return self.entity(e.args[0].binding)
        if e.name == "depth" and len(e.args) == 1 and isinstance(e.args[0], n.Prop) and e.args[0].binding is None:
            return self.resolve(n.Prop(e.args[0].name, "depth"))
        if e.name not in SCALARS:
            raise QueryError(f"no function {e.name}")
        raw = e.name in ("round", "substring")
        args = [a.value if isinstance(a, n.Lit) and (raw and k or e.name == "date_trunc" and not k) else self.value(a) for k, a in enumerate(e.args)]
        return SCALARS[e.name](*args)

    def over(self, e: n.Over) -> Column:
        """A window function; without PARTITION BY all rows are one window, and so one task's."""
        args = [a.value if k and isinstance(a, n.Lit) or e.name == "ntile" and isinstance(a, n.Lit) else self.value(a) for k, a in enumerate(e.args)]
        if e.name in WINDOWS:
            f = WINDOWS[e.name](*args)
        elif e.name in ("count", "sum", "avg", "min", "max", "stddev", "variance"):
            f = F.count(F.lit(1)) if not args else {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "variance": F.variance}[e.name](*args)
        else:
            raise QueryError(f"no window function {e.name}")
        w = Window.partitionBy(*[self.value(x) for x in e.partition])
        if e.order:
            w = w.orderBy(*[self.value(x).asc_nulls_last() if up else self.value(x).desc_nulls_last() for x, up in e.order])
        if e.frame:
            kind, low, high = e.frame
            low, high = (Window.unboundedPreceding if low is None else low), (Window.unboundedFollowing if high is None else high)
            w = w.rowsBetween(low, high) if kind == "rows" else w.rangeBetween(low, high)
        return f.over(w)

    def aggregate(self, e: n.Agg) -> Column:
        if e.arg is None:
            return F.count(F.lit(1))
        x = self.value(e.arg)
        if e.distinct:
            return {"count": F.count_distinct, "sum": F.sum_distinct}.get(e.name, {"avg": F.avg, "min": F.min, "max": F.max}.get(e.name))(x)
        if self.two_valued and e.name == "count":
            return F.count(F.lit(1))
        if self.two_valued and e.name == "sum":
            return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))
        return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev, "variance": F.variance, "approx_count_distinct": F.approx_count_distinct}[e.name](x)

    def condition(self, e: Any, negated: bool = False) -> Column:
        """A column for where(): rows pass where it is true."""
        if not self.two_valued:
            c = self._plain(e)
            return ~c if negated else c
        if isinstance(e, n.Not):
            return self.condition(e.arg, not negated)
        if isinstance(e, n.Op) and e.op in ("and", "or"):
            a, b = self.condition(e.left, negated), self.condition(e.right, negated)
            return a & b if (e.op == "and") != negated else a | b
        if isinstance(e, n.Op) and e.op in ("=", "!="):
            return self.equal(e, (e.op == "=") != negated)
        if isinstance(e, n.Op) and e.op in _REVERSE:
            a, b, comparable = self.sides(e)
            if not comparable:
                return F.lit(negated)
            if not negated:
                return _COMPARE[e.op](a, b)
            out = _COMPARE[_REVERSE[e.op]](a, b)
            for side, x in ((e.left, a), (e.right, b)):
                if not (isinstance(side, n.Lit) and side.value is not None):
                    out = out | x.isNull()
            return out
        if isinstance(e, n.IsNull):
            x = self.value(e.arg)
            return x.isNotNull() if e.negated != negated else x.isNull()
        c = self._plain(e)
        return ~F.coalesce(c, F.lit(False)) if negated else c

    def equal(self, e: n.Op, wanted: bool) -> Column:
        a, b, comparable = self.sides(e)
        if not comparable:  # only two nulls are equal
            if any(isinstance(x, n.Lit) for x in (e.left, e.right)):
                return F.lit(not wanted)
            same = a.isNull() & b.isNull()
            return same if wanted else ~same
        for this, x, y in ((e.right, a, b), (e.left, b, a)):
            if isinstance(this, n.Lit):
                if this.value is None:
                    return x.isNull() if wanted else x.isNotNull()
                return x == y if wanted else (x != y) | x.isNull()
        return a.eqNullSafe(b) if wanted else ~a.eqNullSafe(b)

    def _plain(self, e: Any) -> Column:
        if isinstance(e, n.Op) and e.op in ("and", "or"):
            a, b = self._plain(e.left), self._plain(e.right)
            return a & b if e.op == "and" else a | b
        if isinstance(e, n.Not):
            return ~self._plain(e.arg)
        if isinstance(e, n.Op) and e.op in _COMPARE:
            a, b, comparable = self.sides(e)
            if not comparable:
                return F.when(a.isNotNull() & b.isNotNull(), F.lit(e.op == "!="))
            return _COMPARE[e.op](a, b)
        if isinstance(e, n.Op) and e.op == "like":
            return F.like(self.value(e.left), self.value(e.right))
        if isinstance(e, n.IsNull):
            x = self.value(e.arg)
            return x.isNotNull() if e.negated else x.isNull()
        if isinstance(e, n.InQuery):
            raise QueryError("a condition on a query must stand alone or between ANDs")
        if isinstance(e, n.In):
            c = self.value(e.arg).isin(*[v.value if isinstance(v, n.Lit) else self.value(v) for v in e.values])
            return ~c if e.negated else c
        return self.value(e)
