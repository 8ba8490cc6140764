"""Versioned rows, log recovery and replication as relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(versions: DataFrame) -> DataFrame:
    """Per id the row with the greatest version, by an aggregation that is partial before the shuffle."""
    best = versions.groupBy("id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in versions.columns]), "version").alias("_best"))
    return best.select("_best.*")


def visible(versions: DataFrame, txn: int, dirty: bool = False) -> DataFrame:
    """versions (id, version, created_by, deleted_by, ...): per id the newest version that a transaction sees.

    A dirty reader sees what isn't deleted, or deleted by a later transaction; others what an earlier one made
    and no earlier one, nor they themselves, deleted."""
    alive = F.col("deleted_by").isNull() | (F.col("deleted_by") > txn)
    return newest(versions.where(alive if dirty else (F.col("created_by") < txn) & alive))


def collected(versions: DataFrame, oldest: int) -> DataFrame:
    """What garbage collection leaves: of every id its first version, versions made since the oldest open transaction,
    and those not deleted before it."""
    keep = (F.col("created_by") >= oldest) | F.col("deleted_by").isNull() | (F.col("deleted_by") >= oldest)
    first = F.min("version").over(Window.partitionBy("id"))
    return versions.withColumn("_first", first).where(keep | (F.col("version") == F.col("_first"))).drop("_first")


def latest(versions: DataFrame) -> DataFrame:
    """Per id the newest version, deleted or not."""
    return newest(versions)


def outcomes(log: DataFrame) -> DataFrame:
    """log (pos, txn, kind): per transaction committed, aborted or active, and how many changes it logged."""
    ends = F.max_by(F.when(F.col("kind").isin("commit", "rollback"), F.col("kind")), F.when(F.col("kind").isin("commit", "rollback"), F.col("pos")))
    df = log.groupBy("txn").agg(ends.alias("end"), F.count(F.when(~F.col("kind").isin("begin", "commit", "rollback"), 1)).alias("changes"))
    return df.select("txn", F.when(F.col("end") == "commit", "committed").when(F.col("end") == "rollback", "aborted").otherwise("active").alias("outcome"), "changes")


def redo(log: DataFrame) -> DataFrame:
    """The changes of committed transactions, in log order."""
    done = outcomes(log).where("outcome = 'committed'").select("txn")
    return log.where(~F.col("kind").isin("begin", "commit", "rollback")).join(done, "txn", "left_semi").orderBy("pos")


def entries_since(log: DataFrame, seq: int, batch: int) -> DataFrame:
    """The next entries of a replication log after seq."""
    return log.where(F.col("seq") > seq).orderBy("seq").limit(batch)


def lag(log: DataFrame, applied: DataFrame) -> DataFrame:
    """applied (replica, seq): per replica how many sequence numbers it is behind."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    return applied.groupBy("replica").agg(F.max("seq").alias("seq")).join(F.broadcast(last)).select("replica", "seq", (F.col("last") - F.col("seq")).alias("lag"))


def trimmed(log: DataFrame, applied: DataFrame) -> DataFrame:
    """The log without what all replicas have applied."""
    least = applied.groupBy("replica").agg(F.max("seq").alias("seq")).agg(F.min("seq").alias("least"))
    return log.join(F.broadcast(least)).where(F.col("least").isNull() | (F.col("seq") > F.col("least"))).drop("least")


def applied_changes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base after a change feed (seq, action insert/update/delete, columns of base): per key the last change counts."""
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc()))).where("_n = 1")
    kept = base.join(last.select(key), key, "left_anti").select(base.columns)
    return kept.unionByName(last.where("action <> 'delete'").select(base.columns))
