"""Optional schemas of collections: validation as one pass of columns, defaults, uniqueness."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwork.functions.expressions import Expressions, QueryError
from fernwork.plans.parser import Parser

NONE = object()
#: Types whose values a type takes beside its own: whole numbers as floating ones, and times written as strings.
WIDER = {"double": ("int", "bigint", "float"), "bigint": ("int",), "timestamp": ("string",), "date": ("string",)}


@dataclass(frozen=True)
class Field:
    """type is a Spark type name; check a condition over the row, as text of the query language or parsed."""

    name: str
    type: str
    required: bool = False
    unique: bool = False
    primary: bool = False
    default: Any = NONE
    check: Any = None


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    extra: bool = False  # whether properties that aren't listed may be there

    def errors(self, df: DataFrame, touched: set[str] | None = None) -> Column:
        """array<struct<field, problem>>: of all fields, or of the touched ones of an update."""
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        found: list[Column] = []

        def add(when: Column, name: str, problem: str) -> None:
            found.append(F.when(when, F.struct(F.lit(name).alias("field"), F.lit(problem).alias("problem"))))

        for f in self.fields:
            if touched is not None and f.name not in touched:
                continue
            if f.name not in have:
                if (f.required or f.primary) and f.default is NONE:
                    add(F.lit(True), f.name, "missing")
                continue
            x = F.col(f"`{f.name}`")
            if f.required or f.primary:
                add(x.isNull(), f.name, "missing")
            if have[f.name] not in (f.type, "void", *WIDER.get(f.type, ())):
                add(x.isNotNull(), f.name, "type")
            if f.check:
                e = Parser(f.check).expression() if isinstance(f.check, str) else f.check
                ok = Expressions(lambda p: F.col(f"`{p.name}`"), True, kind=lambda c: df.select(c).schema[0].dataType).condition(e)
                add(x.isNotNull() & ~F.coalesce(ok, F.lit(False)), f.name, "check")
        if not self.extra:
            for name in have.keys() - {f.name for f in self.fields}:
                add(F.col(f"`{name}`").isNotNull(), name, "unknown")
        if not found:
            return F.expr("cast(array() as array<struct<field: string, problem: string>>)")
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    def validated(self, df: DataFrame, touched: set[str] | None = None) -> DataFrame:
        return df.withColumn("errors", self.errors(df, touched))

    def with_defaults(self, df: DataFrame) -> DataFrame:
        """Fields that the table lacks get their default; a null that is there stays."""
        for f in self.fields:
            if f.name not in df.columns and f.default is not NONE:
                df = df.withColumn(f.name, F.lit(f.default).cast(f.type))
        return df

    def repeated(self, df: DataFrame) -> DataFrame:
        """(field, value, rows) where a unique or primary field's value comes more than once."""
        out = None
        for f in self.fields:
            if (f.unique or f.primary) and f.name in df.columns:
                one = df.where(F.col(f"`{f.name}`").isNotNull()).groupBy(F.col(f"`{f.name}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.lit(f.name).alias("field"), "value", "rows")
                out = one if out is None else out.union(one)
        return out if out is not None else df.sparkSession.createDataFrame([], "field string, value string, rows bigint")

    def check(self, df: DataFrame, touched: set[str] | None = None) -> None:
        """Raises a QueryError that names the problems of the first few rows that have any."""
        bad = self.validated(df, touched).where(F.size("errors") > 0).select("errors").limit(5).collect()
        if bad:
            raise QueryError("; ".join(sorted({f"{e['field']}: {e['problem']}" for r in bad for e in r["errors"]})))

    def check_unique(self, whole: DataFrame, new: DataFrame) -> None:
        """Raises if a unique value of the new rows comes more than once in the whole table, which has them already.
        Only rows with a new value are counted."""
        for f in self.fields:
            if (f.unique or f.primary) and f.name in new.columns:
                only_new(whole, new, f.name)


def repeats(whole: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(column, rows): values of the new rows that come more than once in the whole table."""
    values = new.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("_new")).distinct()
    met = whole.join(values, whole[f"`{column}`"] == values["_new"], "left_semi")
    return met.groupBy(F.col(f"`{column}`")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def only_new(whole: DataFrame, new: DataFrame, column: str) -> None:
    if not repeats(whole, new, column).isEmpty():
        raise QueryError(f"{column}: not unique")
