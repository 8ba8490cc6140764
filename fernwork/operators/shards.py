"""Placement of keys: shards by hash, nodes by a ring of virtual nodes."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shards, virtual nodes of a node, copies of a shard.
SHARDS, VIRTUAL, COPIES = 1024, 150, 3


def shard_of(key: Column) -> Column:
    """The first 32 bits of the md5 of the key as text, modulo SHARDS: the same in any engine."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % SHARDS).cast("int")


def _point(text: str) -> str:
    """A place on the ring: the first 64 bits of the md5, in hexadecimal, so that order is order on the ring."""
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:16]


class Ring:
    """Consistent hashing: a key belongs to the next virtual node on the ring, its copies to the next other nodes."""

    def __init__(self, nodes: list[str] | None = None):
        self.points: list[tuple[str, str]] = []
        for x in nodes or ():
            self.add(x)

    def add(self, node: str) -> None:
        for k in range(VIRTUAL):
            bisect.insort(self.points, (_point(f"{node}#{k}"), node))

    def remove(self, node: str) -> None:
        self.points = [p for p in self.points if p[1] != node]

    def nodes_for(self, key: str, copies: int = COPIES) -> list[str]:
        found: dict[str, None] = {}
        at = bisect.bisect_left(self.points, (_point(key), ""))
        for k in range(len(self.points)):
            found.setdefault(self.points[(at + k) % len(self.points)][1])
            if len(found) == copies:
                break
        return list(found)


def shard_map(spark: SparkSession, ring: Ring, copies: int = COPIES) -> DataFrame:
    """(shard, node, copy): 1024 shards' places; copy 0 is the primary."""
    rows = [(s, node, k) for s in range(SHARDS) for k, node in enumerate(ring.nodes_for(f"shard-{s}", copies))]
    return spark.createDataFrame(rows, "shard int, node string, copy int")


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(shard, source, target) of primaries that change their node."""
    a, b = before.where("copy = 0").select("shard", F.col("node").alias("source")), after.where("copy = 0").select("shard", F.col("node").alias("target"))
    return a.join(b, "shard").where("source <> target")


def node_stats(placed: DataFrame) -> DataFrame:
    return placed.groupBy("node").agg(F.count(F.when(F.col("copy") == 0, 1)).alias("primaries"), F.count(F.when(F.col("copy") > 0, 1)).alias("replicas"))


def placement(df: DataFrame, key: str, placed: DataFrame) -> DataFrame:
    """Rows with their shard and primary node; the map of shards has 1024 x copies rows, so it is broadcast."""
    return df.withColumn("shard", shard_of(F.col(key))).join(F.broadcast(placed.where("copy = 0").select("shard", "node")), "shard")
