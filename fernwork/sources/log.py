"""A write-ahead log as an append-only folder of Parquet files, read whole or as a stream.

Entries (pos, txn, kind, statement, collection, image): begin, commit and rollback of transactions, and the statements
in them. A statement that changes rows of a collection adds an entry for each row with its image as JSON: the whole row
after an insert or update, the row that went for a delete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwork.operators.catalog import Catalog
from fernwork.operators.versions import applied_changes, redo

SCHEMA = "pos bigint, txn bigint, kind string, statement string, collection string, image string"


def append(spark: SparkSession, folder: str, entries: list[tuple]) -> None:
    """Adds entries (pos, txn, kind, statement) in one file; a file is there wholly or not at all."""
    spark.createDataFrame([(*e, None, None)[:6] for e in entries], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def append_rows(folder: str, rows: DataFrame, pos: int, txn: int, kind: str, collection: str) -> None:
    """Adds the images of changed rows, one entry a row; they are written where they are."""
    image = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    entry = {"pos": F.lit(pos).cast("bigint"), "txn": F.lit(txn).cast("bigint"), "kind": F.lit(kind), "statement": F.lit(None).cast("string"), "collection": F.lit(collection), "image": image}
    rows.select(*[v.alias(k) for k, v in entry.items()]).write.mode("append").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def replay(spark: SparkSession, folder: str, catalog: Catalog) -> Catalog:
    """The catalog after the committed transactions of a log: of every key of a collection the last change counts.
    Collections without a key, edges and definitions of tables aren't in row images and stay as they are."""
    entries = redo(read(spark, folder)).where("image IS NOT NULL")
    out = catalog.copy()
    for name, c in catalog.collections.items():
        if not c.key:
            continue
        row = F.from_json("image", c.df.schema).alias("r")
        action = F.regexp_replace("kind", "createedge|creategraph", "insert").alias("action")
        changes = entries.where(F.col("collection") == name).select(F.col("pos").alias("seq"), action, row).select("seq", "action", "r.*")
        out.put(c, applied_changes(c.df, changes, c.key))
    return out
