"""Shared helpers: stored intermediate tables, size-checked joins, word expressions, executors' import path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java character class of the ASCII white space that separates words: space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters, for trim() and translate().
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes up to which a table counts as small enough to broadcast; a larger one is joined through a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
#: By application: whether its executors have this package, its temporary folder on a local master, its stored tables.
_shipped: set[str] = set()
_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def pack_code(path: str) -> None:
    """Writes a zip file of this package, its modules and the texts that they read."""
    root = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted([*root.rglob("*.py"), *root.rglob("*.txt")]):
            z.write(f, str(f.relative_to(root.parent)))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that their Python workers can import it wherever
    they run and wherever the session was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="fernwork-ship-")  # Spark itself serves the file from here to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "fernwork_code.zip")
    pack_code(path)
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def work_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a local master, whose tasks all run on
    this machine, gets a temporary folder; any other one must set it, as executors don't see this machine's folders."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="fernwork-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{work_dir(spark)}/fernwork/{app}/llm/{uuid.uuid4().hex}"
    _made.setdefault(app, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that stored() has written for this application, and nothing else; DataFrames that read them
    can't be used any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        inside = F.octet_length(F.array_join(c, "")) + 8 * F.size(c) if isinstance(kind.elementType, T.StringType) else 16 * F.size(c)
        return F.coalesce(F.greatest(inside, F.lit(0)), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def small(df: DataFrame) -> bool:
    """Whether a table's counted rows and bytes allow to broadcast it."""
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return got["n"] <= BROADCAST_ROWS and (got["b"] or 0) <= BROADCAST_BYTES


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Joins with a table that is broadcast only when it is small; rows tells how many it has if its bytes are bounded.

    A larger right side is joined through a shuffle, where adaptive execution splits hot keys."""
    few = small(right) if rows is None else rows <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, on, how)


def whole_ids(docs: DataFrame, id_col: str) -> Column:
    """The ids as long numbers; an error for ids of another type, whose order and conversion aren't defined."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")
    return docs[id_col].cast("long")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, _UPPER, _LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, wherever the optimizer moves or copies the whole expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null, empty and blank texts."""
    trimmed = F.trim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
