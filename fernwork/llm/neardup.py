"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact check of the survivors.

A document is the set of its distinct word shingles; two are linked if their Jaccard similarity is at least
percent / 100. Documents with equal sets form a class, which one of them stands for.

* Candidates share the hash of one of BANDS bands of ROWS minhashes. At a similarity of exactly 0.8 a pair is
  missed by all 40 bands of 6 with probability (1 - 0.8^6)^40 = 5e-6.
* Verification compares the signatures of a candidate pair batch by batch. After m of them with k equal, the
  posterior of the similarity under a flat prior is Beta(k + 1, m - k + 1); the pair is dropped once the
  chance that it reaches the threshold is under MISS, which is P(Bin(m + 1, threshold) <= k).
* Survivors are confirmed on their full sets.

A group is only wanted as a component, so not all its pairs are looked at. In every bucket each member is first
compared with the smallest one. What is left are buckets whose members lie in different components; there a
member is compared with the hub, the member that has the smallest part of its shingles for itself, and then
across components, so that no candidate pair between different components stays unverified. In these two steps
exact bounds rule pairs out first: shingles that no other document of such buckets has can't be shared, of the
hub's shingles a pair shares at most as many as either of the two has, and a link needs
(100 + percent) * shared >= percent * (n_x + n_y). Nothing is capped.

Defined results: texts of fewer words than a shingle are one shingle of all their words; null, empty and blank
texts have none and are linked with nothing; rows that share an id count as linked; a row with a null id has no
component unless an equal set or a link gives it one, and isn't kept; equal texts are ties that the smallest
id wins; texts of many megabytes are read whole; an empty table gives an empty table; other columns are ignored, also
those named like results; ids that aren't whole numbers are refused.

Sets are compared by 64-bit hashes of their shingles, and whole sets by 128 bits: two different shingles of a pair are
taken for one with a chance of about 5e-20.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwork.llm.common import ship, small, small_join, stored, whole_ids
from fernwork.llm.components import components, relabel
from fernwork.llm.hashing import mixed, pieces, split_texts, windows, word_hashes

BANDS, ROWS = 40, 6
#: Signature positions compared at a time, and the chance at which a pair is given up.
BATCH, MISS = 24, 1e-6


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of all the words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(k, len(words))))


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240229).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint64).astype(np.uint32)
    return made[0] | np.uint32(1), made[1]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes, a row per set; the sets aren't empty."""
    a, b = coefficients()
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(flat * a[k] + b[k], starts)
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set of shingles; zeros for the empty one."""
    m = mixed(s)
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(mixed(m ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def signed(rows: DataFrame, k: int) -> DataFrame:
    """Rows (id, text): n_shingles, h1 and h2 (hash of the set), band hashes, signature of a byte a position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            lists, _ = split_texts(part.column("text"), lower=True)
            sets = [shingles(x, k) for x in lists]
            have = [i for i, s in enumerate(sets) if len(s)]
            h = np.array([set_hash(x) for x in sets], np.int64).reshape(-1, 2)
            bands, small = [None] * len(sets), [None] * len(sets)
            if have:
                sig = signatures([sets[i] for i in have])
                key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(have), 1))
                for r in range(ROWS):
                    key = mixed(key * np.uint64(0x100000001B3) + sig[:, r::ROWS])
                for j, i in enumerate(have):
                    bands[i], small[i] = key[j].view(np.int64), (sig[j] & np.uint32(255)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary())], names=["id", "n_shingles", "h1", "h2", "bands", "sig"])

    return rows.mapInArrow(run, "id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, sig binary")


def full_sets(rows: DataFrame, k: int) -> DataFrame:
    """Rows (id, text): (h1, h2, shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            lists, _ = split_texts(part.column("text"), lower=True)
            sets = [shingles(x, k) for x in lists]
            h = np.array([set_hash(x) for x in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["h1", "h2", "shingles"])

    return rows.select("text").mapInArrow(run, "h1 bigint, h2 bigint, shingles array<bigint>")


def least_matches(percent: int) -> list[tuple[int, int]]:
    """For each number m of compared positions the equal ones below which a pair is dropped."""
    t, out = percent / 100, []
    for m in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, k = 0.0, -1
        while tail < MISS and k < m:
            k += 1
            tail += math.exp(math.lgamma(m + 2) - math.lgamma(k + 1) - math.lgamma(m + 2 - k) + k * math.log(t) + (m + 1 - k) * math.log1p(-t)) if t < 1 else float(k == m)
        out.append((m, k))
    return out


def likely(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that sequential comparison of their signatures doesn't drop."""
    steps = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sx", "sy"))
            stay, same, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for m, least in steps:
                same[stay] += (a[stay, done:m] == b[stay, done:m]).sum(axis=1)
                stay, done = stay[same[stay] >= least], m
            yield batch.select(["x", "y"]).take(pa.array(stay))

    both = pairs.join(sigs.select(F.col("node").alias("x"), F.col("sig").alias("sx")), "x").join(sigs.select(F.col("node").alias("y"), F.col("sig").alias("sy")), "y")
    return both.select("x", "y", "sx", "sy").mapInArrow(run, "x bigint, y bigint")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, shared, total): shingles in both full sets, and their sizes' sum. A pair meets its two sets by its own
    key, so a hub is no hot key."""
    ends = pairs.distinct().select("x", "y", F.explode(F.array("x", "y")).alias("node"))
    met = small_join(sets, stored(ends), ["node"]).groupBy("x", "y").agg(F.collect_list("shingles").alias("s"))
    a, b = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    return met.select("x", "y", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), (F.size(a) + F.size(b)).cast("long").alias("total"))


def similar(percent: int) -> Column:
    """100 shared >= percent * union."""
    return (100 + percent) * F.col("shared") >= percent * F.col("total")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    return overlaps(pairs, sets).where(similar(percent)).select("x", "y")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id that can be reached), kept (id = component_id)."""
    ship(docs.sparkSession)
    rows = docs.select(whole_ids(docs, id_col).alias("id"), docs[text_col].cast("string").alias("text"))
    all_rows = stored(signed(rows, k))
    some = all_rows.where("n_shingles > 0")
    classes = stored(some.groupBy("h1", "h2").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    # a class is signed by a row that has its smallest id, or none; the id is part of the join's key, so copies spread
    keyed = classes.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "least", "node")
    first = some.join(keyed, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("id").eqNullSafe(F.col("least")))
    slim = stored(first.select("node", "least", "h1", "h2", "n_shingles", "sig", "bands").dropDuplicates(["node"]))
    spread = slim.select("node", F.explode("bands").alias("key"))
    shared = stored(spread.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep < last").select("key", "rep"))
    members = stored(spread.join(shared, "key").select("key", "node", "rep"))
    inside = stored(members.select("node").distinct())
    sigs = stored(slim.select("node", "least", "h1", "h2", "sig", F.col("n_shingles").alias("n")).join(inside, "node"))
    wanted = stored(sigs.select("least").distinct())
    few = small(wanted)
    mine = rows.join(F.broadcast(wanted) if few else wanted, rows["id"].eqNullSafe(wanted["least"]), "left_semi")
    sets = stored(full_sets(mine, k).join(sigs.select("node", "n", "h1", "h2"), ["h1", "h2"]).select("node", "n", "shingles").dropDuplicates(["node"]))
    # rows that share an id
    placed = some.select("id", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).where("id IS NOT NULL").select("id", "node")
    ends = placed.groupBy("id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("id", "x")
    by_id = stored(placed.join(stored(ends), "id").where("node <> x").select("x", F.col("node").alias("y")))

    def verified(pairs: DataFrame) -> DataFrame:
        return stored(confirmed(stored(likely(stored(pairs.distinct()), sigs, percent)), sets, percent))

    links = stored(by_id.union(verified(members.where("rep <> node").select(F.col("rep").alias("x"), F.col("node").alias("y")))))
    roots = components(links)
    own = sigs.select("node", "n")

    def mixed_buckets(m: DataFrame) -> DataFrame:
        """The members of buckets that reach into different components, with their root."""
        m = relabel(m.drop("root"), roots)
        keys = m.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("n").alias("least")).where("a < b").select("key", "least")
        return stored(m.drop("least").join(stored(keys), "key"))

    apart = mixed_buckets(members.select("key", "node").join(own, "node"))
    if not apart.isEmpty():
        open_sets = sets.join(apart.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("s"))
        alone = open_sets.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
        at_most = stored(apart.select("node").distinct().join(alone, "node", "left").select("node", F.coalesce("alone", F.lit(0)).alias("alone")))
        apart = apart.join(at_most, "node").withColumn("u", F.col("n") - F.col("alone")).drop("alone")
        apart = apart.where((100 + percent) * F.col("u") >= percent * (F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100))))
        apart = mixed_buckets(apart)
        best = apart.groupBy("key").agg(F.max(F.struct((F.col("u") / F.col("n")).alias("part"), (-F.col("node")).alias("neg"), "node")).alias("best"))
        apart = stored(apart.join(stored(best.select("key", F.col("best.node").alias("hub"))), "key"))
        # what each member shares with the hub of its bucket: links, and a closer bound for the other pairs
        with_hub = stored(overlaps(apart.where("hub <> node").select(F.col("hub").alias("x"), F.col("node").alias("y")), sets))
        links = stored(links.union(with_hub.where(similar(percent)).select("x", "y")))
        roots = components(links)
        rest = mixed_buckets(apart)
        if not rest.isEmpty():
            hubs = with_hub.select(F.col("x").alias("hub"), F.col("y").alias("node"), "shared")
            keys = rest.groupBy("node").agg(F.collect_set("key").alias("keys"))
            rest = rest.join(hubs, ["hub", "node"], "left").join(keys, "node").withColumn("c", F.coalesce("shared", "n")).withColumn("e", F.greatest(F.col("u") - F.col("c"), F.lit(0)))
            rest = stored(rest.select("key", "node", "root", "n", "c", "e", "keys"))
            a, b = (rest.select("key", *(F.col(x).alias(f"{side}_{x}") for x in ("node", "root", "n", "c", "e", "keys"))) for side in "ab")
            # of the shared shingles some are the hub's, at most as many as either has, and the others are no one's own
            most = F.least("a_c", "b_c") + F.least("a_e", "b_e")
            bound = (100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))
            once = F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key")
            across = a.join(b, "key").where((F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root")) & bound & once)
            links = stored(links.union(verified(across.select(F.col("a_node").alias("x"), F.col("b_node").alias("y")))))
            roots = components(links)
    named = relabel(classes, roots)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(stored(least), "root").select("h1", "h2", "component")
    out = all_rows.select("id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: DuckDB SQL of near_duplicates over documents (4 words, 80 percent).
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS to_id FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.to_id = e.x),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
