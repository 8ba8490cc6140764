import math
import random

import pytest
from pyspark.sql import functions as F

from fernwork.operators import constraints, joins, paths, pheromone, shards, versions
from fernwork.operators.catalog import Catalog
from fernwork.sources import backup
from fernwork.streaming import feeds


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_schema(spark):
    f = constraints.Field
    s = constraints.Schema((f("id", "bigint", primary=True), f("name", "string", required=True), f("age", "bigint", check="age >= 18 AND age <= 120"), f("stock", "bigint", default=0)))
    df = spark.createDataFrame([(1, "a", 20, None), (1, None, 130, "x"), (None, "c", None, None)], "id bigint, name string, age bigint, other string")
    got = [{(e["field"], e["problem"]) for e in r["errors"]} for r in s.validated(df).collect()]
    assert got == [set(), {("name", "missing"), ("age", "check"), ("other", "unknown")}, {("id", "missing")}]
    assert s.with_defaults(df).where("stock = 0").count() == 3
    assert rows(s.repeated(df)) == [("id", "1", 2)]
    assert [r["errors"] for r in s.validated(df, {"age"}).collect()][0] == []


@pytest.mark.parametrize("unit", ["nanos", "millis"])
def test_traversal_folds(spark, unit):
    rng = random.Random(1)
    log = [(e, k, rng.choice([0, 0, 1, 3, rng.randrange(1, 5_000_000)])) for k, e in enumerate(rng.choices([1, 2, 4], k=90))]
    edges = spark.createDataFrame([(1, 1.0, 0, 0.0), (2, 0.1, 3, 7.0), (3, 0.7, 2, 5.0), (5, None, 0, None)], "edge bigint, pheromone double, traversals bigint, latency double")
    got = {r["edge"]: r for r in pheromone.traversals(edges, spark.createDataFrame(log, "edge bigint, at bigint, latency bigint"), unit).collect()}
    for e, p, n, mean in ((1, 1.0, 0, 0.0), (2, 0.1, 3, 7.0)):
        for x in (v for k, _, v in log if k == e):
            mean = float(x) if mean == 0 else 0.3 * x + 0.7 * mean
            mean = float(math.floor(mean)) if unit == "nanos" else mean
            gain = 1 / (1 + x / 1e6) if unit == "nanos" else 1 / math.log(x + 2) if x > 0 else 0
            p, n = min(max(p + gain, 0.1), 10.0), n + 1
        assert got[e]["traversals"] == n and abs(got[e]["latency"] - mean) < 1e-9 * max(1, mean) and abs(got[e]["pheromone"] - p) < 1e-9
    assert (got[3]["pheromone"], got[3]["traversals"], got[3]["latency"]) == (0.7, 2, 5.0) and got.keys() == {1, 2, 3, 5}


def test_traversal_numbers(spark):
    """Two traversals of 2 ms and 4 ms by hand."""
    e = spark.createDataFrame([(1, 1.0, 0, 0.0)], "edge bigint, pheromone double, traversals bigint, latency double")
    fast = pheromone.traversals(e, spark.createDataFrame([(1, 1, 2_000_000), (1, 2, 4_000_001)], "edge bigint, at bigint, latency bigint")).first()
    assert fast["latency"] == 2_600_000 and abs(fast["pheromone"] - 1.5333332933333413) < 1e-12  # 1 + 1/3 + 1/5.000001
    slow = pheromone.traversals(e, spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 4)], "edge bigint, at bigint, latency bigint"), "millis").first()
    assert abs(slow["latency"] - 2.6) < 1e-12 and abs(slow["pheromone"] - 2.279458147) < 1e-8  # 1 + 0 + 1/ln 4 + 1/ln 6


def test_weights(spark):
    df = spark.createDataFrame([(2.0, 0), (2.0, 1000), (0.5, 1)], "p double, x bigint")
    p, x = F.col("p"), F.col("x")
    got = df.select(pheromone.weight_by_latency(p, x).alias("a"), pheromone.weight_by_cost(p, x).alias("b")).collect()
    want = [(0.5, 0.5), (0.8453877639, 0.8454377390), (2.0, 2.138629436111989)]
    assert all(abs(r["a"] - a) < 1e-9 and abs(r["b"] - b) < 1e-9 for r, (a, b) in zip(got, want, strict=True))


def _has_path(edges, a, b):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        if x == b:
            return True
        if x not in seen:
            seen.add(x)
            todo += [d for s, d in edges if s == x]
    return False


@pytest.mark.parametrize("seed", range(2))
def test_pruned_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(6), rng.randrange(6)): rng.choice([0.1, 0.1, 0.05, 2.0]) for _ in range(16)}
    left = dict(edges)
    for e in sorted(edges):
        if edges[e] <= 0.1 and _has_path([x for x in left if x != e], *e):
            del left[e]
    df = spark.createDataFrame([(*k, v) for k, v in edges.items()], "_src bigint, _dst bigint, pheromone double")
    assert rows(pheromone.pruned(df)) == sorted(((*k, v) for k, v in left.items()), key=repr)


def test_upkeep(spark):
    schema = "_src bigint, _dst bigint, pheromone double, flow bigint, latency double, idle bigint"
    e = spark.createDataFrame([(1, 2, 0.1, 0, 0.0, 100), (1, 3, 0.1, 0, 0.0, 100), (2, 3, 5.0, 3, 10.0, 1), (3, 2, 1.0, 0, 0.0, 100)], schema)
    got = {(r["_src"], r["_dst"]): r["pheromone"] for r in pheromone.reconfigured(e).collect()}
    # without both weak edges 1 would be cut off: the first goes, the second stays
    assert got.keys() == {(1, 3), (2, 3), (3, 2)} and abs(got[2, 3] - (5 + 0.1 * math.log(4) / 1.1)) < 1e-9 and abs(got[3, 2] - 0.95) < 1e-9
    # a weak edge whose other way is four edges long goes as well
    long = spark.createDataFrame([(1, 5, 0.1, 0, 0.0, 100), *((k, k + 1, 1.0, 0, 0.0, 1) for k in range(1, 5))], schema)
    assert (1, 5) not in {(r["_src"], r["_dst"]) for r in pheromone.reconfigured(long).collect()}
    strong = spark.createDataFrame([(1, 2, 8.0), (1, 3, 1.0), (4, 2, 1.0)], "_src bigint, _dst bigint, pheromone double")
    assert rows(pheromone.backups(strong)) == [(3, 2, 0.2)]
    assert rows(pheromone.backups(spark.createDataFrame([(1, 2, 8.0), (1, 3, 1.0), (3, 2, 1.0)], strong.schema))) == []
    h = pheromone.health(strong).first()
    assert (h["edges"], h["nodes"], h["redundancy"], h["status"]) == (3, 4, 0.0, "degraded")
    ring = spark.createDataFrame([(a, b, 1.0) for a in range(4) for b in range(4) if a != b], strong.schema)
    assert pheromone.health(ring).first()["status"] == "healthy"
    none = pheromone.health(strong.limit(0)).first()
    assert (none["edges"], none["nodes"], none["avg_strength"], none["redundancy"], none["status"]) == (0, 0, 0.0, 0.0, "empty")


@pytest.mark.parametrize("seed", range(3))
def test_detours_are_second_paths(spark, seed):
    rng = random.Random(seed)
    e = spark.createDataFrame(list({(rng.randrange(8), rng.randrange(8)) for _ in range(20)}), "_src bigint, _dst bigint")
    many = paths.path_counts(None, e, 3).where("paths > 1").join(e, ["_src", "_dst"], "left_semi").select("_src", "_dst")
    assert rows(paths.detours(e, e)) == rows(many)


def _best_first(edges, start):
    """Of each vertex the path on which a search that goes on with the strongest open path first takes it up."""
    taken, todo = {}, [(0.0, 0, [], [start])]
    while todo:
        todo.sort(key=lambda x: (-x[0], x[1], x[2]))
        score, depth, _, path = todo.pop(0)
        if path[-1] in taken:
            continue
        taken[path[-1]] = (path, score)
        todo += [(score + w, depth + 1, [*path, b], [*path, b]) for (a, b), w in edges.items() if a == path[-1] and b not in taken]
    return taken


@pytest.mark.parametrize("seed", range(2))
def test_strongest(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(7), rng.randrange(7)): rng.choice([0.5, 1.0, 2.0, 4.25]) for _ in range(14)}
    df = spark.createDataFrame([(*k, w) for k, w in edges.items()], "_src bigint, _dst bigint, pheromone double")
    got = {(r["_src"], r["_dst"]): (r["path"], r["score"]) for r in paths.strongest_paths(df.select("_src"), df).collect()}
    want = {(s, v): x for s in {a for a, _ in edges} for v, x in _best_first(edges, s).items() if v != s}
    assert got == want


def test_long_paths(spark):
    """A way of eleven edges beside dead ends."""
    e = spark.createDataFrame([*((k, k + 1, 1.0) for k in range(11)), (3, 50, 2.0), (0, 51, 1.0)], "_src bigint, _dst bigint, pheromone double")
    one = e.where("_src = 0").select("_src")
    for f in (paths.shortest_paths, paths.strongest_paths):
        got = {r["_dst"]: r["path"] for r in f(one, e).collect()}
        assert got[11] == list(range(12)) and got[50] == [0, 1, 2, 3, 50] and len(got) == 13
    assert {r["_dst"] for r in paths.shortest_paths(one, e, 2).collect()} == {1, 2, 51}
    assert paths.walks(one, e).count() == 13 and paths.shortest_paths(one, e.limit(0)).count() == 0 and paths.strongest_paths(one.limit(0), e).count() == 0


def test_ranks_and_communities(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (9, 9), (7, 5), (5, None)], "_src bigint, _dst bigint")
    assert abs(sum(r["rank"] for r in paths.page_rank(e.where("_dst IS NOT NULL"), 30).collect()) - 1) < 1e-9
    assert rows(paths.communities(e)) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (9, 9)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "_src bigint, _dst bigint")
    assert {r["community"] for r in paths.communities(chain).collect()} == {0}


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 3, None), (2, 1, 2, 4), (3, 1, 9, None)], "id bigint, version bigint, created_by bigint, deleted_by bigint")
    assert rows(versions.visible(v, 3)) == [(2, 1, 2, 4)]
    assert rows(versions.visible(v, 5).select("id", "version")) == [(1, 2)]
    assert {r["id"] for r in versions.visible(v, 5, dirty=True).collect()} == {1, 3}
    assert rows(versions.collected(v, 5).select("id", "version")) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    log = spark.createDataFrame([(1, 1, "begin"), (2, 1, "insert"), (3, 2, "begin"), (4, 1, "commit"), (5, 3, "begin"), (6, 3, "rollback")], "pos bigint, txn bigint, kind string")
    assert rows(versions.outcomes(log)) == [(1, "committed", 1), (2, "active", 0), (3, "aborted", 0)]
    assert rows(versions.redo(log).select("pos")) == [(2,)]
    feed = spark.createDataFrame([(k,) for k in range(10)], "seq bigint")
    applied = spark.createDataFrame([("a", 4), ("a", 6), ("b", 9)], "replica string, seq bigint")
    assert rows(versions.lag(feed, applied)) == [("a", 6, 3), ("b", 9, 0)]
    assert versions.trimmed(feed, applied).count() == 3 and versions.entries_since(feed, 5, 2).count() == 2


def test_ring(spark):
    ring = shards.Ring(["a", "b", "c"])
    before = shards.shard_map(spark, ring)
    assert before.count() == 3 * shards.SHARDS and shards.node_stats(before).agg(F.sum("primaries")).first()[0] == shards.SHARDS
    ring.add("d")
    moved = shards.moves(before, shards.shard_map(spark, ring)).collect()
    assert 0 < len(moved) < shards.SHARDS / 2 and {r["target"] for r in moved} == {"d"}
    ring.remove("d")
    assert shards.moves(before, shards.shard_map(spark, ring)).isEmpty()


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k bigint, t bigint")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 8, "c")], "k bigint, t bigint, v string")
    assert rows(joins.as_of(left, right, "k", "t", ["v"])) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]
    rng = random.Random(7)
    a = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(40)]), k) for k in range(60)]
    b = [(rng.choice([1, 1, 1, 3, None]), t, t * 10) for t in rng.sample(range(-5, 60), 30)]
    want = sorted(((k, t, n, max(((u, v) for j, u, v in b if j == k and None not in (k, t) and u <= t), default=(None, None))[1]) for k, t, n in a), key=repr)
    for buckets in (None, 1, 5):
        assert rows(joins.as_of(spark.createDataFrame(a, "k bigint, t bigint, n bigint"), spark.createDataFrame(b, "k bigint, t bigint, v bigint"), "k", "t", ["v"], buckets)) == want
    rng = random.Random(4)
    pts, rgs = [(rng.uniform(-50, 50),) for _ in range(60)], [(x, x + rng.uniform(0, 30)) for x in (rng.uniform(-50, 50) for _ in range(20))]
    got = joins.in_range(spark.createDataFrame(pts, "x double"), "x", spark.createDataFrame(rgs, "a double, b double"), "a", "b", 7.0)
    assert rows(got) == sorted(((x, a, b) for (x,) in pts for a, b in rgs if a <= x <= b), key=repr)


@pytest.mark.parametrize("gzip", [True, False])
def test_backup(spark, tmp_path, gzip):
    c = Catalog()
    c.add("U", spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "id bigint, name string, x double"), "id")
    c.add_edge("E", spark.createDataFrame([(1, 2)], "s bigint, d bigint"), "s", "d", "U", "U")
    folder = str(tmp_path / "b")
    name = backup.create(spark, c, folder, gzip)
    back = backup.restore(spark, folder, name)
    assert rows(back.collections["U"].df) == rows(c.collections["U"].df) and rows(back.edges["E"].df) == [(1, 2)]
    assert backup.listed(spark, folder).first()["id"] == name
    spark.createDataFrame([(9, "z", 0.0)], "id bigint, name string, x double").write.mode("append").json(f"{folder}/{name}/collections/U")
    assert not backup.verify(spark, folder, name)
    with pytest.raises(backup.BackupError):
        backup.restore(spark, folder, name)
    backup.delete(spark, folder, name)
    assert backup.listed(spark, folder).isEmpty()


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "seq bigint, action string, id bigint, x bigint"
    spark.createDataFrame([(1, "insert", 1, 10), (2, "insert", 2, 20)], schema).coalesce(1).write.parquet(source)
    spark.createDataFrame([(3, "update", 1, 11), (4, "delete", 2, None)], schema).coalesce(1).write.mode("append").parquet(source)
    state = {"df": spark.createDataFrame([], "id bigint, x bigint")}
    q = feeds.replicate(feeds.feed(spark, source, schema, 10), "id", lambda: state["df"], lambda df, k: state.update(df=spark.createDataFrame(df.collect(), "id bigint, x bigint")), str(tmp_path / "c"))
    q.awaitTermination()
    assert rows(state["df"]) == [(1, 11)]
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 1, 1_000_000), (1, 2, 3_000_000), (2, 1, 0)], "edge bigint, at bigint, latency bigint").coalesce(1).write.parquet(log)
    q = feeds.strengths(feeds.feed(spark, log, "edge bigint, at bigint, latency bigint")).writeStream.format("memory").queryName("strengths").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["edge"]: r for r in spark.table("strengths").collect()}
    assert got[1]["traversals"] == 2 and got[1]["latency"] == 1_600_000 and abs(got[1]["pheromone"] - 1.75) < 1e-9 and abs(got[2]["pheromone"] - 2.0) < 1e-9


def test_windows_stream_equals_batch(spark, tmp_path):
    df = spark.sql("SELECT timestamp_seconds(1700000000 + id * 97) AS ts, CAST(id % 3 AS STRING) AS event_type, id % 4 AS user_id, CAST(id AS DOUBLE) AS value FROM range(200)")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = feeds.tumbling(feeds.feed(spark, str(tmp_path / "e"), "ts timestamp, event_type string, user_id bigint, value double"), "1 hour")
    q = stream.writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("tumbling")) == rows(feeds.tumbling(df, "1 hour"))


def test_log_folder(spark, tmp_path):
    from fernwork.sources import log

    folder = str(tmp_path / "wal")
    log.append(spark, folder, [(1, 1, "begin", ""), (2, 1, "insert", "x")])
    log.append(spark, folder, [(3, 1, "commit", "")])
    assert rows(versions.outcomes(log.read(spark, folder))) == [(1, "committed", 1)]
    q = log.stream(spark, folder).writeStream.format("memory").queryName("wal").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wal").count() == 3


def test_session_tables(spark):
    from fernwork.operators import indexes
    from fernwork.session import Database

    db = Database(spark)
    db.catalog.add("U", spark.createDataFrame([(1, 5), (2, 8)], "id bigint, x bigint"), "id")
    s = db.session()
    even = F.pandas_udf(lambda x: x % 2 == 0, "boolean")
    assert rows(s.filter("U", lambda df: even(df["x"]))) == [(2, 8)] and rows(s.filter("U", lambda df: df["x"] < 6)) == [(1, 5)]
    assert rows(s.entity("U", 2)) == [(2, 8)]
    s.execute("CREATE INDEX i ON U(x)")
    assert rows(indexes.listed(db.catalog, spark)) == [("i", "U", "x", False)]
