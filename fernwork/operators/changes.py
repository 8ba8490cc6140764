"""Inserts, updates and deletes as new table versions (copy on write), and definitions of tables and edges."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernwork.functions.expressions import Expressions, QueryError
from fernwork.operators.catalog import Catalog, Collection
from fernwork.operators.constraints import NONE, Field, Schema, only_new
from fernwork.plans import nodes as n
from fernwork.plans.compiler import reached
from fernwork.sources.scratch import stored

#: Changes after which a collection's plan is cut by writing the table out.
DEPTH = 16
#: Types of CREATE TABLE.
TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "FLOAT": "double", "REAL": "double", "DOUBLE": "double", "TEXT": "string", "VARCHAR": "string", "STRING": "string", "BOOLEAN": "boolean", "BOOL": "boolean", "TIMESTAMP": "timestamp", "DATE": "date"}


def put(catalog: Catalog, c: Collection, df: DataFrame) -> Collection:
    if c.depth + 1 >= DEPTH:
        df, c = stored(df, "tables"), replace(c, depth=-1)
    return catalog.put(c, df)


def kind_of(values: list) -> T.DataType:
    have = [v for v in values if v is not None]
    if have and all(isinstance(v, bool) for v in have):
        return T.BooleanType()
    if have and all(isinstance(v, int) and not isinstance(v, bool) for v in have):
        return T.LongType()
    return T.DoubleType() if have and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in have) else T.StringType()


def rows_frame(spark: SparkSession, rows: list[dict], like: DataFrame | None = None) -> DataFrame:
    """Rows as a table; columns that `like` has take its types."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    df = spark.createDataFrame([tuple(None if r.get(k) is None else float(r[k]) if isinstance(kind_of([x.get(k) for x in rows]), T.DoubleType) else r[k] for k in names) for r in rows], T.StructType([T.StructField(k, kind_of([r.get(k) for r in rows])) for k in names]))
    known = {f.name: f.dataType for f in like.schema.fields} if like is not None else {}
    return df.select(*[F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in names])


def next_key(c: Collection) -> int:
    """One more than the greatest key; the table is read for it once, later inserts count on."""
    return c.next if c.next is not None else (c.df.agg(F.max(c.key)).first()[0] or 0) + 1


def insert(catalog: Catalog, spark: SparkSession, s: n.Insert) -> tuple[list[int], DataFrame]:
    """Adds rows; a collection that isn't there springs up with the key _id. Returns the new rows' keys, and the rows.

    A collection's schema gives defaults and is kept to: the rows are checked before they are added."""
    c = catalog.collection(s.collection) if catalog.has(s.collection) else None
    names = [x for x in c.df.columns if not (c.key == "_id" and x == "_id")] if c else ()
    rows = [dict(r) if isinstance(r, dict) else dict(zip(s.columns or names, r, strict=True)) for r in s.rows]
    key = c.key if c else "_id"
    schema = c.schema if c else None
    if schema:
        for f in schema.fields:
            if f.default is not NONE:
                for r in rows:
                    r.setdefault(f.name, f.default)
    after = None
    kind = c.df.schema[key].dataType if c and key else T.LongType()
    if key and isinstance(kind, T.IntegralType):
        first = next_key(c) if c and any(r.get(key) is None for r in rows) else c.next if c else 1
        for r in rows:
            if r.get(key) is None:
                r[key], first = first, first + 1
        if first is not None:
            after = max([first, *(r[key] + 1 for r in rows if isinstance(r[key], int))])
    df = rows_frame(spark, rows, c.df if c and not schema else None)
    if schema:
        schema.check(df)
        known = {f.name: f.dataType for f in c.df.schema.fields}
        df = df.select(*[F.col(f"`{x}`").cast(known[x]).alias(x) if x in known else F.col(f"`{x}`") for x in df.columns])
    if c is None:
        catalog.add(s.collection, df, key)
        c = catalog.collections[s.collection] = replace(catalog.collections[s.collection], next=after)
    else:
        c = put(catalog, replace(c, next=after), c.df.unionByName(df, allowMissingColumns=True))
    if schema:
        schema.check_unique(c.df, df)
    return [r[key] for r in rows] if key else [], df


def _expressions(c: Collection, two_valued: bool) -> Expressions:
    def resolve(p: n.Prop) -> Column:
        if p.name not in c.df.columns:
            raise QueryError(f"{c.name} has no property {p.name}")
        return F.col(f"`{p.name}`")

    return Expressions(resolve, two_valued, kind=lambda x: c.df.select(x).schema[0].dataType)


def condition(c: Collection, where: Any, two_valued: bool) -> Column:
    """Null-free: whether a row is meant."""
    return F.lit(True) if where is None else F.coalesce(_expressions(c, two_valued).condition(where), F.lit(False))


def updated(c: Collection, s: n.Update) -> DataFrame:
    """All right sides see the row as it was; new properties become columns."""
    ex, hit = _expressions(c, s.two_valued), condition(c, s.where, s.two_valued)
    kinds = {f.name: f.dataType for f in c.df.schema.fields}
    new = {k: F.when(hit, ex.value(e).cast(kinds[k]) if k in kinds else ex.value(e)) for k, e in s.sets}
    old = [(new[x].otherwise(F.col(f"`{x}`")) if x in new else F.col(f"`{x}`")).alias(x) for x in c.df.columns]
    return c.df.select(*old, *[v.alias(k) for k, v in new.items() if k not in kinds])


def remaining(c: Collection, s: n.Delete) -> DataFrame:
    return c.df.where(~condition(c, s.where, s.two_valued))


def changed(catalog: Catalog, c: Collection, hit: DataFrame, touched: set[str]) -> None:
    """Checks rows after an update against the schema: the touched fields only, and uniqueness of their new values."""
    if c.schema:
        c.schema.check(hit, touched)
        for f in c.schema.fields:
            if (f.unique or f.primary) and f.name in touched:
                only_new(catalog.collection(c.name).df, hit, f.name)


def update(catalog: Catalog, s: n.Update) -> tuple[int, DataFrame]:
    """How many rows the update hit, and these rows as they are then."""
    c = catalog.collection(s.collection)
    met = c.df.where(condition(c, s.where, s.two_valued))
    hit = updated(replace(c, df=met), replace(s, where=None))
    many = met.count()
    put(catalog, c, updated(c, s))
    changed(catalog, c, hit, {k for k, _ in s.sets})
    return many, hit


def update_from(catalog: Catalog, s: n.UpdateFrom) -> tuple[int, DataFrame, str]:
    """Updates the rows of a binding that a traversal reaches, each once however often; and the rows' collection.

    The reached keys are stored, as the query must not see the change."""
    keys, (name,) = reached(catalog, s.query, s.binding)
    keys, c = stored(keys), catalog.collection(name)
    sets = tuple((k, bare(e, s.binding)) for k, e in s.sets)
    two = s.query.two_valued
    new = updated(c, n.Update(c.name, sets, None, two))
    at = keys.select(F.col("_0").alias("_hit")).where("_hit IS NOT NULL")
    both = replace(c, df=c.df.join(at, F.col(f"`{c.key}`") == F.col("_hit"), "left"))
    full = updated(both, n.Update(c.name, sets, n.Not(n.IsNull(n.Prop(None, "_hit"))), two)).drop("_hit")
    hit = new.join(at, F.col(f"`{c.key}`") == F.col("_hit"), "left_semi")
    many = c.df.join(at, F.col(f"`{c.key}`") == F.col("_hit"), "left_semi").count()
    put(catalog, c, full)
    changed(catalog, c, hit, {k for k, _ in s.sets})
    return many, hit, c.name


def bare(e: Any, binding: str) -> Any:
    """An expression over the row itself: the binding's properties without its name."""
    if isinstance(e, n.Prop):
        if e.binding not in (None, binding):
            raise QueryError(f"an update of {binding} can't use {e.binding}")
        return n.Prop(None, e.name)
    if isinstance(e, n.Op):
        return replace(e, left=bare(e.left, binding), right=bare(e.right, binding))
    if isinstance(e, (n.Not, n.Neg, n.IsNull)):
        return replace(e, arg=bare(e.arg, binding))
    if isinstance(e, n.Func):
        return replace(e, args=tuple(bare(x, binding) for x in e.args))
    if isinstance(e, n.Case):
        return n.Case(tuple((bare(a, binding), bare(b, binding)) for a, b in e.branches), None if e.default is None else bare(e.default, binding))
    return e


def delete(catalog: Catalog, s: n.Delete) -> tuple[int, DataFrame]:
    """How many rows went, and the rows. Edges of deleted rows stay and vanish from traversals; with CASCADE they are
    taken out as well."""
    c = catalog.collection(s.collection)
    gone = c.df.where(condition(c, s.where, s.two_valued))
    many = gone.count()
    left = remaining(c, s)
    put(catalog, c, left)
    if s.cascade and c.key:
        alive = left.select(F.col(c.key).alias("_alive"))
        for name, e in list(catalog.edges.items()):
            df = e.df
            if e.source_collection == c.name:
                df = df.join(alive, df[e.source] == alive["_alive"], "left_semi")
            if e.target_collection == c.name:
                df = df.join(alive, df[e.target] == alive["_alive"], "left_semi")
            catalog.edges[name] = replace(e, df=df, version=e.version + 1)
    return many, gone


def add_edges(catalog: Catalog, name: str, new: DataFrame) -> int:
    """Adds edges (source, target, properties by the edge type's column names) whose two ends exist; returns how many."""
    e = catalog.edges[name]
    for column, collection in ((e.source, e.source_collection), (e.target, e.target_collection)):
        c = catalog.collection(collection)
        ends = c.df.select(F.col(c.key).alias("_end")).distinct()
        new = new.join(ends, new[column] == ends["_end"], "left_semi")
    many = new.count()
    catalog.edges[name] = replace(e, df=e.df.unionByName(new, allowMissingColumns=True), version=e.version + 1)
    return many


def create_edge(catalog: Catalog, spark: SparkSession, s: n.CreateEdge) -> int:
    """CREATE (key)-[:T]->(key) {properties}, of an edge type that is there."""
    if s.type not in catalog.edges:
        raise QueryError(f"no edge type {s.type}")
    e = catalog.edges[s.type]
    return add_edges(catalog, s.type, rows_frame(spark, [{e.source: s.source.value, e.target: s.target.value, **s.props}], e.df))


def create_graph(catalog: Catalog, spark: SparkSession, s: n.CreateGraph) -> dict[str, int]:
    """CREATE of nodes and edges: nodes are always new, an edge type springs up at its first edge. Keys by variable."""
    keys: dict[str, int] = {}
    labels = {}
    for variable, label, props in s.nodes:
        if label is None:
            raise QueryError("a new node needs a label")
        labels[variable] = label
        keys[variable] = insert(catalog, spark, n.Insert(label, (props,)))[0][0]
    for a, kind, b, props in s.edges:
        if kind is None:
            raise QueryError("a new edge needs a type")
        row = {"_src": keys[a], "_dst": keys[b], **props}
        if kind in catalog.edges:
            e = catalog.edges[kind]
            add_edges(catalog, kind, rows_frame(spark, [{e.source: keys[a], e.target: keys[b], **props}], e.df))
        else:
            catalog.add_edge(kind, rows_frame(spark, [row]), "_src", "_dst", labels[a], labels[b])
    return keys


def create_from(catalog: Catalog, s: n.CreateFrom) -> int:
    """An edge for each different pair of two bindings' rows in a query; an edge type springs up if it isn't there."""
    pairs, (a, b) = reached(catalog, s.query, s.source, s.target)
    if s.type in catalog.edges:
        e = catalog.edges[s.type]
        if (e.source_collection, e.target_collection) != (a, b):
            raise QueryError(f"{s.type} goes from {e.source_collection} to {e.target_collection}")
        ends = (e.source, e.target)
    else:
        ends = ("_src", "_dst")
    new = stored(pairs.select(F.col("_0").alias(ends[0]), F.col("_1").alias(ends[1]), *[F.lit(v).alias(k) for k, v in s.props.items()]), "tables")
    if s.type in catalog.edges:
        return add_edges(catalog, s.type, new)
    catalog.add_edge(s.type, new, *ends, a, b)
    return new.count()


def create_table(catalog: Catalog, spark: SparkSession, s: n.CreateTable) -> None:
    """An empty collection with the schema that its constraints make; one of that name that is there stays as it is.
    The key is the column PRIMARY KEY, else one named id or _id, else a column _id that numbers the rows."""
    if catalog.has(s.name):
        return
    columns = [(c, TYPES.get(t, "string")) for c, t, _ in s.columns]
    fields = tuple(Field(c, TYPES.get(t, "string"), **rules) for c, t, rules in s.columns)
    key = next((f.name for f in fields if f.primary), None) or next((c for c, _ in columns if c.lower() in ("id", "_id")), None)
    if key is None:
        key, columns, fields = "_id", [("_id", "bigint"), *columns], (Field("_id", "bigint"), *fields)
    catalog.add(s.name, spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns)), key, Schema(fields) if any(r for *_, r in s.columns) else None)


def drop_collection(catalog: Catalog, name: str) -> None:
    c = catalog.collection(name)
    del catalog.collections[c.name]
    for k in [k for k, e in catalog.edges.items() if c.name in (e.source_collection, e.target_collection)]:
        del catalog.edges[k]
