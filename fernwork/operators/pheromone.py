"""Usage-weighted edges: strength that evaporates and is reinforced, weights, upkeep of a network."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwork.operators.paths import detours
from fernwork.sources.scratch import counted, stored

#: Strength at the start, its least and greatest, what is left after an evaporation, smoothing of latencies, and the threshold of a stale edge.
INITIAL, LEAST, MOST, KEPT, ALPHA, STALE = 1.0, 0.1, 10.0, 0.95, 0.3, 0.5
#: Fixed values of upkeep: seconds after which an edge is idle, strength over which an edge is important, strength of added edges.
IDLE, IMPORTANT, ADDED = 60, 7.0, 0.2


def clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(LEAST)), F.lit(MOST))


def evaporated(edges: DataFrame) -> DataFrame:
    return edges.withColumn("pheromone", F.greatest(F.col("pheromone") * KEPT, F.lit(LEAST)))


def reinforced(edges: DataFrame, by: Column) -> DataFrame:
    return edges.withColumn("pheromone", clamped(F.col("pheromone") + by))


def weight_by_latency(pheromone: Column, nanos: Column) -> Column:
    """1 / strength, more for slow edges; an edge without a latency counts as fast."""
    slow = F.when(nanos > 0, F.ln(nanos.cast("double")) / 10).otherwise(0.0)
    return F.lit(1.0) / pheromone * (1 + slow)


def weight_by_cost(pheromone: Column, cost: Column) -> Column:
    """1 / strength, more for costly edges (milliseconds); an edge without a cost counts as cheap."""
    slow = F.when(cost > 0, F.ln(cost.cast("double") + 1) / 10).otherwise(0.0)
    return F.lit(1.0) / pheromone * (1 + slow)


def stale(edges: DataFrame, threshold: float = STALE) -> DataFrame:
    return edges.where(F.col("pheromone") < threshold)


def gain(latency: Column, unit: str = "nanos") -> Column:
    """What a traversal adds to the strength, by its own latency: fast ones add more; in milliseconds 0 adds nothing."""
    if unit == "nanos":
        return 1 / (1 + latency / 1e6)
    return F.when(latency > 0, 1 / F.ln(latency + 2)).otherwise(0.0)


def smoothed(average: float, latency: float, unit: str = "nanos") -> float:
    """The average latency after one more; while it is 0 the next one is taken as it is. Nanoseconds are whole."""
    if average == 0:
        return latency
    new = ALPHA * latency + (1 - ALPHA) * average
    return float(int(new)) if unit == "nanos" else new


def traversals(edges: DataFrame, log: DataFrame, unit: str = "nanos") -> DataFrame:
    """edges (edge, pheromone, traversals, latency) after a log (edge, at, latency), taken in order of `at`.

    Counts and strength don't depend on the order (gains are never negative, so clamping at the end is clamping at
    every step) and are aggregated before the shuffle, whatever an edge's share of the log. The average latency does
    depend on it: the log is sorted by edge and time and folded as a stream, in constant memory; one edge's log is
    one task's stream, as each step needs the one before. An edge without a log stays as it is."""
    log = log.where("edge IS NOT NULL AND latency IS NOT NULL").select("edge", "at", F.col("latency").cast("double").alias("latency"))
    seen = log.groupBy("edge").agg(F.count(F.lit(1)).alias("_n"), F.sum(gain(F.col("latency"), unit)).alias("_gain"))
    start = edges.where("edge IS NOT NULL").select("edge", F.lit(0).alias("_log"), F.lit(None).cast(log.schema["at"].dataType).alias("at"), F.col("latency").cast("double").alias("latency"))
    line = start.unionByName(log.select("edge", F.lit(1).alias("_log"), "at", "latency")).repartition("edge").sortWithinPartitions("edge", "_log", "at", "latency")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, average, logged, known = None, 0.0, False, False
        for batch in batches:
            done: list[tuple] = []
            for edge, is_log, latency in zip(*(batch.column(c).to_pylist() for c in ("edge", "_log", "latency")), strict=True):
                if edge != current:
                    if known and logged:
                        done.append((current, average))
                    current, average, logged, known = edge, 0.0, False, False
                if is_log:
                    average, logged = smoothed(average, latency, unit), True
                else:
                    average, known = latency or 0.0, True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], batch.schema.field("edge").type), pa.array([x for _, x in done], pa.float64())], names=["edge", "_latency"])
        if known and logged:
            yield pa.RecordBatch.from_arrays([pa.array([current], batch.schema.field("edge").type), pa.array([average], pa.float64())], names=["edge", "_latency"])

    averages = line.mapInArrow(fold, f"edge {edges.schema['edge'].dataType.simpleString()}, _latency double")
    df = edges.join(seen, "edge", "left").join(averages, "edge", "left")
    used = F.col("_n").isNotNull()
    return (
        df.withColumn("pheromone", F.when(used, clamped(F.col("pheromone") + F.col("_gain"))).otherwise(F.col("pheromone").cast("double")))
        .withColumn("traversals", F.col("traversals").cast("bigint") + F.coalesce("_n", F.lit(0)))
        .withColumn("latency", F.coalesce("_latency", F.col("latency").cast("double"))).select(edges.columns)
    )


def trail_quality(trails: DataFrame) -> DataFrame:
    """Plan trails (pheromone, runs, successes, ms): quality = strength x success rate / (1 + ms / 100)."""
    rate = F.when(F.col("runs") > 0, F.col("successes") / F.col("runs")).otherwise(0.0)
    return trails.withColumn("quality", F.col("pheromone") * rate / (1 + F.col("ms") / 100.0))


def trails_kept(trails: DataFrame, capacity: int, least: float = 0.2, minutes: int = 60) -> DataFrame:
    """Trails (pheromone, runs, successes, ms, idle minutes) after an upkeep: they evaporate, weak and long unused
    ones go, and of the others the best `capacity` by quality stay (equal quality: by all columns)."""
    df = evaporated(trails).where((F.col("pheromone") >= least) & (F.col("idle") <= minutes))
    return trail_quality(df).orderBy(F.col("quality").desc(), *trails.columns).limit(capacity)


def refreshed(edges: DataFrame, idle: int = IDLE) -> DataFrame:
    """Edges (pheromone, flow, latency in ms, idle seconds): those used lately gain 0.1 ln(flow + 1) / (1 + latency /
    100) and begin to count their flow anew, others evaporate."""
    used = F.col("idle") < idle
    more = 0.1 * F.ln(F.col("flow") + 1.0) / (1 + F.col("latency") / 100.0)
    strength = F.when(used, F.least(F.col("pheromone") + more, F.lit(MOST))).otherwise(F.greatest(F.col("pheromone") * KEPT, F.lit(LEAST)))
    return edges.withColumn("pheromone", strength).withColumn("flow", F.when(used, F.col("flow") * 0).otherwise(F.col("flow")))


def pruned(edges: DataFrame) -> DataFrame:
    """Edges without the weak ones (at the least strength) that can be spared, looked at one after the other in order of
    (_src, _dst): one goes if what is left then, without it, still has a path of any length between its ends.

    An edge surely goes if such a path exists over edges that are there when its turn comes whatever happens before:
    strong and kept ones, and weak ones after it. It surely stays if there is none over all edges that aren't gone. A
    round decides all sure ones, and at least the first that is open, as nothing before it is. The searches of all
    open edges advance side by side over stored frontiers and end at their targets."""
    rows = stored(edges.where("_src IS NOT NULL AND _dst IS NOT NULL").groupBy("_src", "_dst").agg((F.max("pheromone") <= LEAST).alias("weak")))
    graph = rows.where("NOT weak").select("_src", "_dst", F.lit(None).cast(rows.schema["_src"].dataType).alias("_s"), F.lit(None).cast(rows.schema["_dst"].dataType).alias("_d"))
    loops = rows.where("weak AND _src = _dst").select("_src", "_dst")  # no path at all is needed instead
    open_edges, gone = stored(rows.where("weak AND _src <> _dst").select("_src", "_dst")), loops

    def joined(wanted: DataFrame, sure: bool) -> DataFrame:
        """The wanted edges whose ends have a path over firm edges, and open ones: any, or those after the edge."""
        steps = stored(graph.unionByName(open_edges.select("_src", "_dst", F.col("_src").alias("_s"), F.col("_dst").alias("_d"))).select(F.col("_src").alias("_m"), F.col("_dst").alias("_n"), "_s", "_d"))
        front, many = counted(wanted.select("_src", "_dst", F.col("_src").alias("_at")))
        seen, met = front, None
        after = (F.struct("_s", "_d") > F.struct("_src", "_dst")) if sure else (F.struct("_s", "_d") != F.struct("_src", "_dst"))
        while many:
            far = front.join(steps, F.col("_at") == F.col("_m")).where(F.col("_s").isNull() | after).select("_src", "_dst", F.col("_n").alias("_at"))
            far = stored(far.distinct().join(seen, ["_src", "_dst", "_at"], "left_anti"))
            there = far.where("_at = _dst").select("_src", "_dst")
            met = there if met is None else met.unionByName(there)
            seen = seen.unionByName(far)
            front, many = counted(far.join(met, ["_src", "_dst"], "left_anti"))
        return met if met is not None else wanted.limit(0)

    while not open_edges.isEmpty():
        way = stored(joined(open_edges, False))
        spare = stored(joined(way, True)) if not way.isEmpty() else way
        gone = gone.unionByName(spare)
        stay = open_edges.join(way, ["_src", "_dst"], "left_anti")
        graph = stored(graph.unionByName(stay.select("_src", "_dst", F.lit(None).cast(rows.schema["_src"].dataType).alias("_s"), F.lit(None).cast(rows.schema["_dst"].dataType).alias("_d"))))
        open_edges = stored(way.join(spare, ["_src", "_dst"], "left_anti"))
    return edges.join(gone, ["_src", "_dst"], "left_anti").select(edges.columns)


def backups(edges: DataFrame) -> DataFrame:
    """(_src, _dst, pheromone) of edges to add around important ones (over 7) with no second path of up to three edges:
    source to middle and middle to target. The middle is the smallest vertex that the source leads to or that leads to
    the target. All are found on the graph as it is, so an edge added for one doesn't count for another."""
    base = stored(edges.where("_src IS NOT NULL AND _dst IS NOT NULL").select("_src", "_dst").distinct())
    strong = edges.where(F.col("pheromone") > IMPORTANT).select("_src", "_dst").distinct()
    alone = stored(strong.join(detours(strong, base), ["_src", "_dst"], "left_anti"))
    after = alone.join(base.select("_src", F.col("_dst").alias("_mid")), "_src")
    before = alone.join(base.select(F.col("_src").alias("_mid"), "_dst"), "_dst").select("_src", "_dst", "_mid")
    middle = after.select("_src", "_dst", "_mid").unionByName(before).where("_mid <> _src AND _mid <> _dst").groupBy("_src", "_dst").agg(F.min("_mid").alias("_mid"))
    new = middle.select(F.explode(F.array(F.struct("_src", F.col("_mid").alias("_dst")), F.struct(F.col("_mid").alias("_src"), "_dst"))).alias("e")).select("e.*").distinct()
    return new.join(base, ["_src", "_dst"], "left_anti").withColumn("pheromone", F.lit(ADDED))


def reconfigured(edges: DataFrame, idle: int = IDLE) -> DataFrame:
    """edges (_src, _dst, pheromone, flow, latency, idle seconds) after one round of flow-driven upkeep: refreshed, then
    pruned, then with the backups added, which have no flow, latency or idle time. One edge a pair is expected."""
    left = stored(pruned(stored(refreshed(edges, idle))))
    kinds = {f.name: f.dataType for f in left.schema.fields}
    new = backups(left)
    added = new.select(*[(F.col(c) if c in new.columns else F.lit(0) if c in ("flow", "latency", "idle") else F.lit(None)).cast(kinds[c]).alias(c) for c in left.columns])
    return left.unionByName(added)


def health(edges: DataFrame) -> DataFrame:
    """One row: edges, nodes, avg_strength, redundancy (share of connected pairs with a further path of up to three
    edges) and status: healthy if that is over one half, else degraded; empty (with zeros) without edges."""
    pairs = stored(edges.where("_src IS NOT NULL AND _dst IS NOT NULL").select("_src", "_dst").distinct())
    nodes = pairs.select(F.col("_src").alias("v")).union(pairs.select("_dst")).agg(F.count_distinct("v").alias("nodes"))
    share = pairs.agg(F.count(F.lit(1)).alias("_all")).join(F.broadcast(detours(pairs, pairs).agg(F.count(F.lit(1)).alias("_more"))))
    out = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.avg("pheromone"), F.lit(0.0)).alias("avg_strength")).join(F.broadcast(nodes)).join(F.broadcast(share))
    part = F.when(F.col("_all") > 0, F.col("_more") / F.col("_all")).otherwise(0.0)
    status = F.when(F.col("edges") == 0, "empty").when(part > 0.5, "healthy").otherwise("degraded")
    return out.select("edges", "nodes", "avg_strength", part.alias("redundancy"), status.alias("status"))
