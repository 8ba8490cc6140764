"""Collections (tables whose rows are vertices) and edge types (tables of source and target keys)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.functions.expressions import QueryError


@dataclass(frozen=True)
class Collection:
    """version grows with every change; a change is a new table, the old one stays readable."""

    name: str
    df: DataFrame
    key: str | None = None
    version: int = 0
    depth: int = 0  # changes since the table was last written out
    next: int | None = None  # the next key to give, if it is known
    schema: Any = None  # a constraints.Schema that inserts and updates keep to


@dataclass(frozen=True)
class EdgeType:
    name: str
    df: DataFrame
    source: str  # column with the source's key
    target: str
    source_collection: str
    target_collection: str
    version: int = 0
    foreign: tuple[str, str] | None = None  # ("source" or "target", column): that collection's rows hold the other's key

    def ends(self) -> DataFrame:
        """All columns, with _src and _dst first."""
        rest = [c for c in self.df.columns if c not in (self.source, self.target)]
        return self.df.select(F.col(self.source).alias("_src"), F.col(self.target).alias("_dst"), *rest)


@dataclass
class Catalog:
    collections: dict[str, Collection] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str, bool]] = field(default_factory=dict)

    def collection(self, name: str) -> Collection:
        for k, c in self.collections.items():
            if k == name or k.lower() == name.lower():
                return c
        raise QueryError(f"no collection {name}")

    def has(self, name: str) -> bool:
        return name.lower() in map(str.lower, self.collections)

    def add(self, name: str, df: DataFrame, key: str | None = None, schema: Any = None) -> None:
        self.collections[name] = Collection(name, df, key, schema=schema)

    def add_edge(self, name: str, df: DataFrame, source: str, target: str, source_collection: str, target_collection: str, foreign: tuple[str, str] | None = None) -> None:
        """foreign tells that an edge is no more than a foreign key, so that a hop needs one join and not two."""
        self.edges[name] = EdgeType(name, df, source, target, source_collection, target_collection, foreign=foreign)

    def foreign_key(self, e: EdgeType) -> tuple[str, str] | None:
        """(side, column), as long as neither the edges nor the rows that hold the key have been changed."""
        if e.foreign is None or e.version:
            return None
        c = self.collections.get(e.source_collection if e.foreign[0] == "source" else e.target_collection)
        return e.foreign if c is not None and c.version == 0 else None

    def put(self, c: Collection, df: DataFrame) -> Collection:
        """A collection's next version."""
        c = self.collections[c.name] = replace(c, df=df, version=c.version + 1, depth=c.depth + 1)
        return c

    def copy(self) -> Catalog:
        return Catalog(dict(self.collections), dict(self.edges), dict(self.indexes))

    def leaving(self, collection: str, types: tuple[str, ...], direction: str) -> list[tuple[EdgeType, bool]]:
        """Edge types that leave a collection's vertices, each with whether it is walked against its direction."""
        unknown = [t for t in types if t not in self.edges]
        if unknown:
            raise QueryError(f"no edge type {unknown[0]}")
        chosen = [self.edges[t] for t in types] if types else list(self.edges.values())
        out = [(e, False) for e in chosen if direction in ("out", "both") and e.source_collection == collection]
        return out + [(e, True) for e in chosen if direction in ("in", "both") and e.target_collection == collection]
