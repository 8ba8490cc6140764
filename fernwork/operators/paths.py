"""Walks over edge tables (_src, _dst): reachability at least depth, shortest, strongest and all paths, ranks, groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwork.sources.scratch import counted, stored


#: Hops up to which a walk doesn't look what it has met before: it is over before that pays.
SHORT = 3


def reachable(starts: DataFrame, edges: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(_src, _dst, depth): every vertex that a start (_src) reaches, once, at its least number of hops; not itself.

    The edges are stored once, and each level once if a further one builds on it. Longer and open walks go on with new
    pairs only, so cycles end and the work is bounded by the pairs there are."""
    steps = stored(edges.select(F.col("_src").alias("_m"), F.col("_dst").alias("_n")).where("_m IS NOT NULL AND _n IS NOT NULL").distinct())
    front = steps.join(starts.select(F.col("_src").alias("_m")), "_m", "left_semi").select(F.col("_m").alias("_src"), F.col("_n").alias("_dst"))
    onward = lambda df: df.join(steps, F.col("_dst") == F.col("_m")).select("_src", F.col("_n").alias("_dst"))
    if most is not None and most <= SHORT:
        levels = [front.withColumn("depth", F.lit(1))] if most > 0 else [front.withColumn("depth", F.lit(0)).limit(0)]
        for hop in range(2, most + 1):
            front = onward(front).distinct()
            front = stored(front) if hop < most else front
            levels.append(front.withColumn("depth", F.lit(hop)))
        found = levels[0]
        for x in levels[1:]:
            found = found.unionByName(x)
        return found.where("_src <> _dst").groupBy("_src", "_dst").agg(F.min("depth").alias("depth")).where(F.col("depth") >= max(least, 1))
    front, many = counted(front.where("_src <> _dst").withColumn("depth", F.lit(1)))
    seen, hop = front, 1
    while many and (most is None or hop < most):
        hop += 1
        # the anti join comes first, so what is known already doesn't go through the aggregation
        new = onward(front).where("_src <> _dst").join(seen.select("_src", "_dst"), ["_src", "_dst"], "left_anti").distinct()
        front, many = counted(new.withColumn("depth", F.lit(hop)))
        if many:
            seen = seen.unionByName(front)
    return seen.where(F.col("depth") >= max(least, 1))


def traverse(vertices: DataFrame, key: str, start: int, edges: DataFrame, depth: int, passes: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Breadth-first search from one vertex: (key, depth) in order of depth. Vertices that fail `passes` are neither
    given nor gone through, the start included."""
    allowed = vertices.where(passes(vertices)) if passes else vertices
    allowed = allowed.select(F.col(key).alias("_v"))
    inner = edges.join(allowed.withColumnRenamed("_v", "_src"), "_src", "left_semi").join(allowed.withColumnRenamed("_v", "_dst"), "_dst", "left_semi")
    starts = allowed.where(F.col("_v") == start).select(F.col("_v").alias("_src"))
    found = reachable(starts, inner.select("_src", "_dst"), 1, depth)
    return found.select(F.col("_dst").alias(key), "depth")


def walks(starts: DataFrame | None, edges: DataFrame, most: int | None = None) -> DataFrame:
    """All simple paths, of at most `most` edges if that is given: (_src, _dst, path, depth, score); score sums the
    edges' `weight`, 0 without. Without starts they begin everywhere. The edges are stored once, and each level once
    if a further one builds on it. The number of paths grows with the power of the degree."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(0.0)
    steps = stored(edges.select(F.col("_src").alias("_m"), F.col("_dst").alias("_n"), weight.alias("_w")))
    first = steps if starts is None else steps.join(starts.select(F.col("_src").alias("_m")), "_m", "left_semi")
    front = first.where("_m <> _n").select(F.col("_m").alias("_src"), F.col("_n").alias("_dst"), F.array("_m", "_n").alias("path"), F.lit(1).alias("depth"), F.col("_w").alias("score"))
    out, hop, many = front, 1, 1
    while many and (most is None or hop < most):
        hop += 1
        far = front.join(steps, F.col("_dst") == F.col("_m")).where(~F.array_contains("path", F.col("_n")))
        front = far.select("_src", F.col("_n").alias("_dst"), F.array_append("path", F.col("_n")).alias("path"), F.lit(hop).alias("depth"), (F.col("score") + F.col("_w")).alias("score"))
        if hop != most:
            front, many = counted(front)
        out = out.unionByName(front)
    return out if most is None or most > 0 else out.limit(0)


def path_counts(starts: DataFrame | None, edges: DataFrame, most: int = 3) -> DataFrame:
    """(_src, _dst, paths): simple paths of at most `most` edges."""
    return walks(starts, edges, most).groupBy("_src", "_dst").agg(F.count(F.lit(1)).alias("paths"))


def strongest_paths(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Per pair the path that a best-first search finds, however long: (_src, _dst, path, depth, score).

    From each start the open path with the greatest sum of pheromone goes on, and a vertex counts as visited at the
    first path that is taken up to it. The searches of all starts advance side by side, a vertex each a round: every
    start keeps its open paths in a table, takes the best (ties: the shorter, then the smaller path), and adds those
    to its new neighbours. Of parallel edges the strongest counts. `most` bounds the edges of a path if given."""
    steps = stored(edges.where("_src IS NOT NULL AND _dst IS NOT NULL").groupBy(F.col("_src").alias("_m"), F.col("_dst").alias("_n")).agg(F.max("pheromone").cast("double").alias("_w")))
    front, many = counted(starts.select("_src").distinct().select("_src", F.col("_src").alias("_dst"), F.array("_src").alias("path"), F.lit(0).alias("depth"), F.lit(0.0).alias("score")))
    done = None
    while many:
        rank = F.struct("score", (-F.col("depth")).alias("near"), F.transform("path", lambda x: -x).alias("small"), "_dst", "path", "depth")
        best = stored(front.groupBy("_src").agg(F.max(rank).alias("m")).select("_src", "m._dst", "m.path", "m.depth", "m.score"))
        done = best if done is None else done.unionByName(best)
        grown = best if most is None else best.where(F.col("depth") < most)
        far = grown.join(steps, F.col("_dst") == F.col("_m")).select("_src", F.col("_n").alias("_dst"), F.array_append("path", F.col("_n")).alias("path"), (F.col("depth") + 1).alias("depth"), (F.col("score") + F.col("_w")).alias("score"))
        # an open path to a vertex that has been visited, or to one with a better open path, is never taken up
        left = front.unionByName(far).join(done.select("_src", "_dst"), ["_src", "_dst"], "left_anti")
        keep = F.struct("score", (-F.col("depth")).alias("near"), F.transform("path", lambda x: -x).alias("small"), "path", "depth")
        front, many = counted(left.groupBy("_src", "_dst").agg(F.max(keep).alias("m")).select("_src", "_dst", "m.path", "m.depth", "m.score"))
    empty = front if done is None else done
    return empty.where("depth > 0")


def shortest_paths(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Per pair the smallest of its shortest paths, however long: (_src, _dst, path, depth).

    A frontier carries one path a pair: of a pair's shortest paths the smallest goes through the smallest shortest
    path to the vertex before, so no more are needed. Only new pairs go on. `most` bounds the edges if given."""
    steps = stored(edges.select(F.col("_src").alias("_m"), F.col("_dst").alias("_n")).where("_m IS NOT NULL AND _n IS NOT NULL").distinct())
    front = stored(starts.select("_src").distinct().select("_src", F.col("_src").alias("_dst"), F.array("_src").alias("path")))
    seen, found, hop = front.select("_src", "_dst"), None, 0
    while most is None or hop < most:
        hop += 1
        far = front.join(steps, F.col("_dst") == F.col("_m")).select("_src", F.col("_n").alias("_dst"), F.array_append("path", F.col("_n")).alias("path"))
        new = far.join(seen, ["_src", "_dst"], "left_anti").groupBy("_src", "_dst").agg(F.min("path").alias("path"))
        front, many = counted(new)
        level = front.withColumn("depth", F.lit(hop))
        found = level if found is None else found.unionByName(level)
        if not many:
            break
        seen = seen.unionByName(front.select("_src", "_dst"))
    return found if found is not None else front.withColumn("depth", F.lit(0)).limit(0)


def detours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Of distinct pairs (_src, _dst) of edges those with a further path of two or three edges: the first is enough,
    so paths are neither listed nor counted."""
    base = stored(edges.select("_src", "_dst").where("_src <> _dst").distinct())
    out, back = base.select("_src", F.col("_dst").alias("_a")), base.select(F.col("_src").alias("_b"), "_dst")
    pairs = stored(pairs.select("_src", "_dst").where("_src <> _dst").distinct())
    first = pairs.join(out, "_src").where("_a <> _dst")
    two = stored(first.join(base.select(F.col("_src").alias("_a"), "_dst"), ["_a", "_dst"], "left_semi").select("_src", "_dst").distinct())
    rest = pairs.join(two, ["_src", "_dst"], "left_anti")
    ends = rest.join(out, "_src").where("_a <> _dst").join(back, "_dst").where("_b <> _src AND _a <> _b")
    three = ends.join(base.select(F.col("_src").alias("_a"), F.col("_dst").alias("_b")), ["_a", "_b"], "left_semi").select("_src", "_dst").distinct()
    return two.unionByName(three)


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after some rounds; rank of vertices without outgoing edges is given up to all."""
    edges = stored(edges.select("_src", "_dst"))
    nodes = stored(edges.select(F.col("_src").alias("node")).union(edges.select("_dst")).distinct())
    total = nodes.count()
    out = edges.groupBy("_src").agg(F.count(F.lit(1)).alias("out"))
    rank = nodes.withColumn("rank", F.lit(1.0 / total if total else 0.0))
    for _ in range(rounds):
        with_out = rank.join(out, rank["node"] == out["_src"], "left")
        lost = with_out.where(F.col("out").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = with_out.where(F.col("out").isNotNull()).select(F.col("node").alias("_src"), (F.col("rank") / F.col("out")).alias("part"))
        got = edges.join(given, "_src").groupBy(F.col("_dst").alias("node")).agg(F.sum("part").alias("part"))
        rank = stored(nodes.join(got, "node", "left").select("node", (F.lit((1 - damping) / total + damping * lost / total) + damping * F.coalesce("part", F.lit(0.0))).alias("rank")))
    return rank


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): the connected groups of the graph without directions, named by their smallest vertex.

    Every round each vertex points to its smallest neighbour, pointers are followed twice, and links between
    vertices of one group go; a chain shrinks to a quarter or less a round."""
    links = stored(edges.select("_src", "_dst").where("_src IS NOT NULL AND _dst IS NOT NULL").distinct())
    named = stored(links.select(F.col("_src").alias("node")).union(links.select("_dst")).distinct().withColumn("community", F.col("node")))
    links = links.where("_src <> _dst")
    while not links.isEmpty():
        both = links.select(F.col("_src").alias("_x"), F.col("_dst").alias("_y")).union(links.select("_dst", "_src"))
        to = stored(both.groupBy("_x").agg(F.min("_y").alias("_y")).select("_x", F.least("_x", "_y").alias("_p")))
        for _ in range(2):
            to = stored(to.join(to.select(F.col("_x").alias("_p"), F.col("_p").alias("_q")), "_p").select("_x", F.col("_q").alias("_p")))
        named = stored(named.join(to.withColumnRenamed("_x", "community"), "community", "left").select("node", F.coalesce("_p", "community").alias("community")))
        a, b = (to.select(F.col("_x").alias(c), F.col("_p").alias(p)) for c, p in (("_src", "_ps"), ("_dst", "_pd")))
        links = stored(links.join(a, "_src").join(b, "_dst").where("_ps <> _pd").select(F.col("_ps").alias("_src"), F.col("_pd").alias("_dst")).distinct())
    return named
