"""Stored intermediate tables, in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Temporary folders by application, for local masters without the setting.
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a local master, whose tasks all run in
    this process, gets a temporary folder; any other one must set it, as executors don't see this machine's folders."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="fernwork-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


def new_path(spark: SparkSession, purpose: str = "work") -> str:
    """A path of this application's own; committed tables ("tables") stay apart from intermediate ones ("work")."""
    return f"{folder(spark)}/fernwork/{spark.sparkContext.applicationId}/{purpose}/{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str = "work") -> DataFrame:
    """df written as a table and read back: the plan behind it is cut, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The same, with the number of rows, which the writing job counts on its way."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]
