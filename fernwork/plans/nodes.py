"""The logical plan that all three languages are parsed to."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Prop:
    """A property; without a binding it is looked up in the bindings from left to right."""

    binding: str | None
    name: str


@dataclass(frozen=True)
class Star:
    binding: str | None = None


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class Neg:
    arg: Any


@dataclass(frozen=True)
class Op:
    """and or = != < <= > >= + - * / % like"""

    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    arg: Any
    negated: bool = False


@dataclass(frozen=True)
class In:
    arg: Any
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Agg:
    """count sum avg min max; arg None is the star."""

    name: str
    arg: Any = None
    distinct: bool = False


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple


@dataclass(frozen=True)
class Over:
    """A window function; frame is (rows or range, from, to) with None for an open end."""

    name: str
    args: tuple
    partition: tuple = ()
    order: tuple = ()  # of (expression, ascending)
    frame: tuple | None = None


@dataclass(frozen=True, eq=False)
class InQuery:
    """arg IN (query); arg None: EXISTS (query)."""

    arg: Any
    query: Any
    negated: bool = False


@dataclass(frozen=True, eq=False)
class ScalarQuery:
    """A query of one row and column as a value."""

    query: Any


@dataclass(frozen=True)
class Case:
    branches: tuple  # of (condition, value)
    default: Any = None


@dataclass(frozen=True)
class Item:
    expr: Any
    name: str | None = None


@dataclass(frozen=True)
class Hop:
    """An edge pattern from one binding to another. least and most are hops where `path` is set; most None: unbounded."""

    source: str
    target: str
    types: tuple[str, ...] = ()
    direction: str = "out"  # out, in, both
    edge: str | None = None
    path: bool = False
    least: int = 1
    most: int | None = 1
    collection: str | None = None  # what the target is to be
    strength: Any = None  # edges of more than this pheromone only
    shortest: bool = False  # the path itself is asked for


@dataclass(frozen=True)
class JoinStep:
    collection: str
    alias: str
    kind: str = "inner"
    on: Any = None


@dataclass
class Select:
    collection: str
    alias: str
    steps: list = field(default_factory=list)  # Hop and JoinStep, in order
    where: Any = None
    items: list[Item] = field(default_factory=list)
    group: list = field(default_factory=list)
    having: Any = None
    order: list = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    two_valued: bool = True  # the query language's comparisons; SQL and Cypher have three values
    cube: str | None = None  # rollup, cube or sets
    sets: list = field(default_factory=list)  # grouping sets, as lists of expressions
    strict: bool = False  # values of different types are never equal (Cypher)


@dataclass
class SetOp:
    kind: str  # union, union all, intersect, intersect all, except, except all
    left: Any
    right: Any


@dataclass
class With:
    """Named queries, each of which sees those before it, and the query over them."""

    tables: list  # of (name, query)
    body: Any


@dataclass(frozen=True)
class Insert:
    collection: str
    rows: tuple  # of dicts: column -> literal
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Update:
    collection: str
    sets: tuple  # of (column, expression)
    where: Any = None
    two_valued: bool = True


@dataclass(frozen=True)
class Delete:
    collection: str
    where: Any = None
    two_valued: bool = True
    cascade: bool = False


@dataclass(frozen=True)
class UpdateFrom:
    """Updates the rows of a binding that a query reaches."""

    query: Any
    binding: str
    sets: tuple  # of (column, expression)


@dataclass(frozen=True)
class CreateFrom:
    """Makes an edge between each different pair of two bindings' rows that a query gives."""

    query: Any
    source: str
    type: str
    target: str
    props: dict


@dataclass(frozen=True)
class CreateEdge:
    source: Any
    type: str
    target: Any
    props: dict


@dataclass(frozen=True)
class CreateGraph:
    """Nodes (variable, label, properties) and edges (source variable, type, target variable, properties)."""

    nodes: tuple
    edges: tuple


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple  # of (name, type, constraints: a dict of required, unique, primary, default, check)


@dataclass(frozen=True)
class CreateIndex:
    name: str
    collection: str
    column: str
    unique: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class Transaction:
    action: str  # begin, commit, rollback
    isolation: str | None = None


def walk(e: Any):
    """An expression and all below it, queries inside it left out."""
    yield e
    for name in getattr(e, "__dataclass_fields__", ()):
        if name == "query":
            continue
        x = getattr(e, name)
        for y in x if isinstance(x, tuple) else (x,):
            for z in y if isinstance(y, tuple) else (y,):
                if hasattr(z, "__dataclass_fields__"):
                    yield from walk(z)


def conjuncts(e: Any) -> list:
    return [] if e is None else conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Op) and e.op == "and" else [e]


def joined(conditions: list) -> Any:
    """The conjunction of conditions, None for none."""
    out = None
    for c in conditions:
        out = c if out is None else Op("and", out, c)
    return out
