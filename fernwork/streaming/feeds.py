"""Streams: a change feed applied to a table, windows over events, edge strength kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from fernwork.operators.pheromone import INITIAL, LEAST, MOST, smoothed
from fernwork.operators.versions import applied_changes


def feed(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def replicate(changes: DataFrame, key: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes (seq, action, columns) batch by batch; write gets the next table and the batch's
    number, so a batch that is replayed after a failure can be told."""

    def batch(df: DataFrame, number: int) -> None:
        write(applied_changes(read(), df, key), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums per window and key; events later than `late` behind the newest are dropped by a stream."""
    df = events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return df.select(F.col("window.start").alias("start"), by, "events", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    df = events.withWatermark(at, late).groupBy(F.window(at, width, step), by).agg(F.count(F.lit(1)).alias("events"))
    return df.select(F.col("window.start").alias("start"), by, "events")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", at: str = "ts", by: str = "user_id") -> DataFrame:
    df = events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("events"))
    return df.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "events")


def strengths(log: DataFrame) -> DataFrame:
    """A stream of traversals (edge, at, latency in nanoseconds) to each edge's state after every batch:
    (edge, traversals, latency, pheromone), by the rules of operators.pheromone.traversals. Late rows of a batch are
    put in order within it; the average of an edge's batch is folded with its state, the gains are summed at once."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, latency, strength = state.get if state.exists else (0, 0.0, INITIAL)
        rows = pd.concat(list(frames)).sort_values(["at", "latency"])["latency"].to_numpy("float64")
        for x in rows:
            latency = smoothed(latency, float(x))
        strength = min(max(strength + float((1 / (1 + rows / 1e6)).sum()), LEAST), MOST)
        n += len(rows)
        state.update((n, latency, strength))
        yield pd.DataFrame({"edge": [key[0]], "traversals": [n], "latency": [latency], "pheromone": [strength]})

    return log.groupBy("edge").applyInPandasWithState(fold, "edge bigint, traversals bigint, latency double, pheromone double", "n bigint, latency double, pheromone double", "update", "NoTimeout")
