"""Backups of a catalog: JSON (optionally gzip) per table, a checksum that doesn't depend on row order, metadata."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernwork.operators.catalog import Catalog, Collection, EdgeType


class BackupError(RuntimeError):
    pass


def checksum(df: DataFrame) -> str:
    """Sum of the rows' hashes and their number; the same for any order of rows and columns' files."""
    row = F.to_json(F.struct(*sorted(f"`{c}`" for c in df.columns)))
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{total['n']}:{total['s'] or 0}"


def _write(df: DataFrame, path: str, gzip: bool) -> dict:
    df.write.json(path, compression="gzip" if gzip else "none")
    return {"schema": df.schema.json(), "checksum": checksum(df)}


def _text(spark: SparkSession, path: str, text: str | None = None) -> str:
    """Reads or writes a small file through Hadoop, so any store will do."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if text is not None:
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        return text
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def create(spark: SparkSession, catalog: Catalog, folder: str, gzip: bool = True) -> str:
    """Writes all collections and edge types; returns the backup's id."""
    name = uuid.uuid4().hex
    meta: dict = {"id": name, "made": time.time(), "gzip": gzip, "collections": {}, "edges": {}}
    for k, c in catalog.collections.items():
        meta["collections"][k] = {"key": c.key, **_write(c.df, f"{folder}/{name}/collections/{k}", gzip)}
    for k, e in catalog.edges.items():
        meta["edges"][k] = {"ends": [e.source, e.target, e.source_collection, e.target_collection], **_write(e.df, f"{folder}/{name}/edges/{k}", gzip)}
    _text(spark, f"{folder}/{name}/metadata.json", json.dumps(meta))
    return name


def metadata(spark: SparkSession, folder: str, name: str) -> dict:
    try:
        return json.loads(_text(spark, f"{folder}/{name}/metadata.json"))
    except Exception as e:
        raise BackupError(f"no backup {name}") from e


def _read(spark: SparkSession, path: str, m: dict) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(m["schema"]))).json(path)


def verify(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether every table reads back with its checksum."""
    meta = metadata(spark, folder, name)
    return all(checksum(_read(spark, f"{folder}/{name}/{kind}/{k}", m)) == m["checksum"] for kind in ("collections", "edges") for k, m in meta[kind].items())


def restore(spark: SparkSession, folder: str, name: str) -> Catalog:
    if not verify(spark, folder, name):
        raise BackupError(f"backup {name} is damaged")
    meta, out = metadata(spark, folder, name), Catalog()
    for k, m in meta["collections"].items():
        out.collections[k] = Collection(k, _read(spark, f"{folder}/{name}/collections/{k}", m), m["key"])
    for k, m in meta["edges"].items():
        out.edges[k] = EdgeType(k, _read(spark, f"{folder}/{name}/edges/{k}", m), *m["ends"])
    return out


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(id, made, gzip, tables) of all backups in a folder."""
    at, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [metadata(spark, folder, x) for x in names]
    return spark.createDataFrame([(m["id"], m["made"], m["gzip"], len(m["collections"]) + len(m["edges"])) for m in found], "id string, made double, gzip boolean, tables int")


def delete(spark: SparkSession, folder: str, name: str) -> None:
    metadata(spark, folder, name)
    at, fs = _fs(spark, f"{folder}/{name}")
    fs.delete(at, True)
