"""The façade: a catalog, the three languages, transactions, and the graph interface."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from fernwork.functions.expressions import QueryError
from fernwork.operators import changes, indexes, paths, stats
from fernwork.operators.catalog import Catalog
from fernwork.plans import nodes as n
from fernwork.plans.compiler import compile_query
from fernwork.plans.lexer import tokenize
from fernwork.plans.parser import language, parse
from fernwork.sources import log
from fernwork.sources.scratch import new_path

#: Parsed statements that a database remembers, and log entries that it holds back.
PLANS, PENDING = 1000, 1000
#: Statements that are queries.
QUERY = (n.Select, n.SetOp, n.With)


class TransactionError(RuntimeError):
    pass


@dataclass
class Database:
    """The committed state that sessions share. Versions of collections tell whether another session was faster."""

    spark: SparkSession
    catalog: Catalog = field(default_factory=Catalog)
    plans: OrderedDict = field(default_factory=OrderedDict)
    log_folder: str | None = None  # where the log is kept; by default among the application's own tables
    images: bool = False  # whether changed rows are logged, so that replay() can do them again
    pending: list[tuple[int, int, str, str]] = field(default_factory=list)  # entries not yet in the folder
    logged: int = 0
    last_txn: int = 0

    def session(self) -> Session:
        return Session(self)

    def parse(self, text: str, lang: str | None) -> Any:
        """Remembered by its tokens, so white space doesn't matter outside literals."""
        key = (lang, tuple((t.kind, t.text) for t in tokenize(text)))
        if key in self.plans:
            self.plans.move_to_end(key)
        else:
            self.plans[key] = parse(text, lang)
            if len(self.plans) > PLANS:
                self.plans.popitem(last=False)
        return self.plans[key]

    def write_log(self, txn: int, kind: str, text: str = "", rows: DataFrame | None = None, collection: str | None = None) -> None:
        """Adds an entry; entries go to the folder PENDING at a time, those of changed rows at once."""
        self.logged += 1
        self.pending.append((self.logged, txn, kind, text))
        if self.images and rows is not None:
            self.flush()
            log.append_rows(self.log_folder, rows, self.logged, txn, kind, collection)
        if len(self.pending) >= PENDING:
            self.flush()

    def flush(self) -> None:
        if self.log_folder is None:
            self.log_folder = new_path(self.spark, "log")
        if self.pending:
            log.append(self.spark, self.log_folder, self.pending)
            self.pending = []

    def log_frame(self) -> DataFrame:
        """(pos, txn, kind, statement) of all entries, images left out."""
        self.flush()
        if not self.logged:
            return self.spark.createDataFrame([], "pos bigint, txn bigint, kind string, statement string")
        return log.read(self.spark, self.log_folder).where("image IS NULL").select("pos", "txn", "kind", "statement")


class Session:
    """Changes outside a transaction commit at once. Within one, queries see the snapshot of its start and its own
    changes; at commit the first of two sessions that changed the same table wins."""

    def __init__(self, db: Database):
        self.db, self.spark = db, db.spark
        self.own: Catalog | None = None
        self.base: Catalog | None = None
        self.txn = 0

    @property
    def catalog(self) -> Catalog:
        return self.own or self.db.catalog

    # statements
    def execute(self, text: str, lang: str | None = None) -> DataFrame:
        """Rows of a query; for anything else one row with rows_affected (and the new keys of inserts)."""
        s = self.db.parse(text, lang)
        if isinstance(s, QUERY):
            return compile_query(self.catalog, s)
        if isinstance(s, n.Transaction):
            getattr(self, s.action)()
            return self.affected(0)
        if isinstance(s, (n.CreateIndex, n.DropIndex)):
            self.define(s)
            return self.affected(0)
        return self.change(s, text)

    def sql(self, text: str) -> DataFrame:
        return self.execute(text, "sql")

    def cypher(self, text: str) -> DataFrame:
        return self.execute(text, "cypher")

    def explain(self, text: str, lang: str | None = None) -> dict[str, str]:
        s = self.db.parse(text, lang)
        plan = ""
        if isinstance(s, QUERY):
            plan = compile_query(self.catalog, s)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return {"language": lang or language(text), "plan": repr(s), "spark": plan}

    def affected(self, rows: int, ids: list | None = None) -> DataFrame:
        return self.spark.createDataFrame([(rows, [int(x) for x in ids or ()])], "rows_affected bigint, ids array<bigint>")

    def define(self, s: n.CreateIndex | n.DropIndex) -> None:
        if isinstance(s, n.DropIndex):
            indexes.drop(self.catalog, s.name)
        else:
            indexes.create(self.catalog, s.name, s.collection, s.column, s.unique)

    def change(self, s: Any, text: str) -> DataFrame:
        alone = self.own is None
        if alone:
            self.begin()
        try:
            ids, new, name = [], None, getattr(s, "collection", None)
            if isinstance(s, n.Insert):
                ids, new = changes.insert(self.catalog, self.spark, s)
                rows = len(s.rows)
            elif isinstance(s, n.Update):
                rows, new = changes.update(self.catalog, s)
            elif isinstance(s, n.UpdateFrom):
                rows, new, name = changes.update_from(self.catalog, s)
            elif isinstance(s, n.Delete):
                rows, gone = changes.delete(self.catalog, s)
            elif isinstance(s, n.CreateEdge):
                rows = changes.create_edge(self.catalog, self.spark, s)
            elif isinstance(s, n.CreateFrom):
                rows = changes.create_from(self.catalog, s)
            elif isinstance(s, n.CreateGraph):
                ids = list(changes.create_graph(self.catalog, self.spark, s).values())
                rows = len(s.nodes) + len(s.edges)
            elif isinstance(s, n.CreateTable):
                changes.create_table(self.catalog, self.spark, s)
                rows = 0
            else:
                raise QueryError(f"can't run {type(s).__name__}")
            name = self.catalog.collection(name).name if name else None
            if new is not None:
                indexes.check_unique(self.catalog, name, new)
            kind = {"updatefrom": "update"}.get(type(s).__name__.lower(), type(s).__name__.lower())
            self.db.write_log(self.txn, kind, text, gone if isinstance(s, n.Delete) else new, name)
        except Exception:
            if alone:
                self.rollback()
            raise
        if alone:
            self.commit()
        return self.affected(rows, ids)

    # transactions
    def begin(self) -> None:
        if self.own is not None:
            raise TransactionError("a transaction is open")
        self.db.last_txn += 1
        self.txn = self.db.last_txn
        self.base, self.own = self.db.catalog.copy(), self.db.catalog.copy()
        self.db.write_log(self.txn, "begin")

    def commit(self) -> None:
        if self.own is None:
            raise TransactionError("no transaction is open")
        now = self.db.catalog
        for kind in ("collections", "edges", "indexes"):
            was, mine, there = (getattr(x, kind) for x in (self.base, self.own, now))
            for name in was.keys() | mine.keys():
                if mine.get(name) is not was.get(name) and there.get(name) is not was.get(name):
                    self.rollback()
                    raise TransactionError(f"{name} was changed by another transaction")
        for kind in ("collections", "edges", "indexes"):
            was, mine, there = (getattr(x, kind) for x in (self.base, self.own, now))
            for name in was.keys() | mine.keys():
                if mine.get(name) is not was.get(name):
                    if name in mine:
                        there[name] = mine[name]
                    else:
                        there.pop(name, None)
        self.db.write_log(self.txn, "commit")
        self.own = self.base = None

    def rollback(self) -> None:
        if self.own is None:
            raise TransactionError("no transaction is open")
        self.db.write_log(self.txn, "rollback")
        self.own = self.base = None

    # tables
    def view(self, name: str, text: str, key: str | None = None) -> None:
        """Makes a query's rows a collection; the query runs when the collection is read."""
        self.catalog.add(name, self.execute(text), key)

    def insert_from(self, collection: str, rows: DataFrame) -> None:
        """Adds the rows of a table; columns that the collection lacks are added to it."""
        c = self.catalog.collection(collection)
        kinds = {f.name: f.dataType for f in c.df.schema.fields}
        changes.put(self.catalog, c, c.df.unionByName(rows.select(*[rows[x].cast(kinds[x]).alias(x) if x in kinds else rows[x] for x in rows.columns]), allowMissingColumns=True))

    def filter(self, collection: str, passes: Callable[[DataFrame], Column]) -> DataFrame:
        """Rows that pass: passes gets the table and gives a condition, built-in or a pandas UDF over its columns."""
        df = self.catalog.collection(collection).df
        return df.where(passes(df))

    def entity(self, collection: str, key: int) -> DataFrame:
        c = self.catalog.collection(collection)
        return c.df.where(c.df[c.key] == key)

    # graph interface
    def edges(self, *types: str) -> DataFrame:
        """(_src, _dst, _type, pheromone) of some edge types, or all."""
        df = stats.all_edges(self.catalog)
        return df.where(df["_type"].isin(*types)) if types else df

    def traverse(self, collection: str, start: int, edge: str, depth: int, passes=None, direction: str = "out") -> DataFrame:
        c, e = self.catalog.collection(collection), self.catalog.edges[edge].ends().select("_src", "_dst")
        back = e.select(e["_dst"].alias("_src"), e["_src"].alias("_dst"))
        e = e if direction == "out" else back if direction == "in" else e.union(back)
        return paths.traverse(c.df, c.key, start, e, depth, passes)


def query(db: Database, text: str) -> DataFrame:
    """One statement in a session of its own."""
    return db.session().execute(text)
