"""The index interface. A table needs no index structure: lookups are conditions that Parquet's statistics prune by,
and `clustered` writes a table sorted by the key so that they prune well."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwork.functions.expressions import QueryError
from fernwork.operators.catalog import Catalog
from fernwork.operators.constraints import repeats
from fernwork.sources.scratch import new_path


def create(catalog: Catalog, name: str, collection: str, column: str, unique: bool = False) -> None:
    if name in catalog.indexes:
        raise QueryError(f"index {name} exists")
    c = catalog.collection(collection)
    if column not in c.df.columns:
        raise QueryError(f"{collection} has no property {column}")
    if unique and not violations(c.df, column).isEmpty():
        raise QueryError(f"{collection}.{column} isn't unique")
    catalog.indexes[name] = (c.name, column, unique)


def drop(catalog: Catalog, name: str) -> None:
    if catalog.indexes.pop(name, None) is None:
        raise QueryError(f"no index {name}")


def listed(catalog: Catalog, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in sorted(catalog.indexes.items())], "name string, collection string, property string, is_unique boolean")


def violations(df: DataFrame, column: str) -> DataFrame:
    """(column, rows) of values that occur more than once; nulls aren't indexed."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def check_unique(catalog: Catalog, collection: str, new: DataFrame) -> None:
    """Raises if a value of the new rows breaks a unique index; only rows that have one of these values are looked at."""
    for name, (c, column, unique) in catalog.indexes.items():
        if unique and c == collection and column in new.columns and not repeats(catalog.collections[c].df, new, column).isEmpty():
            raise QueryError(f"{c}.{column} isn't unique ({name})")


def lookup(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def between(df: DataFrame, column: str, low: Any = None, high: Any = None) -> DataFrame:
    """Both ends belong to the range; an end that is None is open."""
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low))
    return df.where(F.col(column) <= F.lit(high)) if high is not None else df.where(F.col(column).isNotNull())


def greater(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.where(F.col(column) > F.lit(value))


def less(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.where(F.col(column) < F.lit(value))


def stats(df: DataFrame, column: str) -> DataFrame:
    """One row: keys (distinct values) and entries."""
    return df.agg(F.count_distinct(column).alias("keys"), F.count(column).alias("entries"))


def clustered(df: DataFrame, column: str) -> DataFrame:
    """The table written in order of the column, so that each file holds a narrow range of it."""
    path = new_path(df.sparkSession, "tables")
    df.repartitionByRange(F.col(column)).sortWithinPartitions(column).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
