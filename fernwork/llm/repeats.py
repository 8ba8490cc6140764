"""Removal of word runs that repeat across documents, by level-wise doubling of repeated windows.

A window is `length` (50) consecutive words. A word goes if it is covered by a window that also starts in a
document with a smaller id. Levels have a quarter, half and the whole of that length, each at most twice the
one before, and only windows that are repeated at one level are looked at on the next:

* Quarter: of each full window only its quarter-length part with the least hash counts ("anchor"), which is
  the same in every copy of the window; so about one part in twenty has to be compared over the corpus. A full
  window stays a candidate while its anchor occurs in another document.
* Half: hashes of the two halves of each candidate. It stays while both halves occur in another document.
* Whole: 128-bit hash of each candidate, with the least document id that holds it.

The level-wise tables hold, per block of documents, each different hash once, so a passage that a third of all
documents share costs a row per block and level. Blocks are hashes of ids and buckets are hashes of windows;
either has a bounded share of the data. Exact copies of a text are settled by their text's 128-bit hash first.

Defined results: null and blank texts have no words; texts under `length` words lose nothing; a null id is
neither smaller nor larger than another, so its row loses nothing and gives nothing; rows that share an id
don't affect each other, and each input row has its own result row; an empty table gives an empty table;
other columns are ignored, also those named like results; ids that aren't whole numbers are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.llm.common import ship, small_join, stored, whole_ids
from fernwork.llm.hashing import pieces, sliding_min, split_texts, windows, word_hashes

#: Words in a block of documents, and window hashes in a bucket, at about which a further one is opened.
BLOCK_WORDS, BUCKET_HASHES = 500_000, 1_000_000
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(w: np.ndarray, length: int) -> np.ndarray:
    """For each full window in w, the least hash of its quarter-length parts."""
    if len(w) < length:
        return np.empty(0, np.uint64)
    quarter = -(-length // 4)
    return sliding_min(windows(w, quarter), length - quarter + 1)


def summary(docs: DataFrame, length: int) -> DataFrame:
    """Per row of (id, text): n_words, h1 and h2 (hash of the words in order), sha256 of the words, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            lists, _ = split_texts(part.column("text"))
            h1, h2, sha, found = [], [], [], []
            for words in lists:
                whole = b" ".join(words)
                digest = hashlib.sha256(whole)
                sha.append(digest.hexdigest())
                a, b = np.frombuffer(digest.digest()[:16], np.int64)
                h1.append(a), h2.append(b)
                found.append(np.unique(anchors(word_hashes(words), length)).view(np.int64) if len(words) >= length else None)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in lists], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["id", "n_words", "h1", "h2", "sha", "anchors"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_words bigint, h1 bigint, h2 bigint, sha string, anchors array<bigint>")


class Block:
    """The documents of a block: words' hashes side by side, and the candidate windows by place."""

    def __init__(self, table: pa.Table, length: int):
        self.length, half = length, -(-length // 2)
        table = table.combine_chunks()
        self.keys = table.select(["id", "h1", "h2"])
        self.words, self.offsets = split_texts(table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text"))
        flat = word_hashes([x for words in self.words for x in words])
        found, owner = [], []
        for k, known in enumerate(table.column("anchors")):
            a, b = self.offsets[k], self.offsets[k + 1]
            least = anchors(flat[a:b], length)
            known = np.asarray(known.values).view(np.uint64)
            at = np.flatnonzero(np.isin(least, known)) + a
            found.append(at)
            owner.append(np.full(len(at), k))
        self.at = np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)
        self.owner = np.concatenate([*owner, np.empty(0, np.int64)]).astype(np.int64)
        ids = table.column("id").to_numpy().astype(np.int64)
        self.id = ids[self.owner] if len(self.owner) else np.empty(0, np.int64)
        self.halves = windows(flat, half) if len(flat) >= half else np.empty(0, np.uint64)
        self.second = length - half
        self.flat = flat

    def half_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate([self.halves[self.at], self.halves[self.at + self.second]])
        return h, np.zeros(len(h), np.uint64), np.concatenate([self.id, self.id])

    def narrow(self, repeated: np.ndarray) -> None:
        """Leaves the candidates both of whose halves are repeated."""
        stay = np.isin(self.halves[self.at], repeated) & np.isin(self.halves[self.at + self.second], repeated)
        self.at, self.owner, self.id = self.at[stay], self.owner[stay], self.id[stay]

    def whole_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64), self.id
        return windows(self.flat, self.length)[self.at], windows(self.flat, self.length, 1)[self.at], self.id


def least_by_key(h: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys with their least and greatest ids, and for each input row the place of its key."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    starts = np.flatnonzero(first)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(first) - 1
    if not len(h):
        return h, g, low, high, place
    return h[starts], g[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts), place


def packed(arrays: list[np.ndarray]) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in arrays]


SENT = "bucket int, block int, h binary, g binary, low binary, high binary"
BACK = "block int, h binary, g binary, low binary"


def sent_rows(block: int, h: np.ndarray, g: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """A block's different keys, packed into a row per bucket."""
    h, g, low, high, _ = least_by_key(h, g, ids, ids)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(order) else np.empty(0, np.int64)
    rows = []
    for a, b in zip(cut, [*cut[1:], len(order)], strict=True) if len(order) else ():
        pick = order[a:b]
        rows.append((int(bucket[pick[0]]), block, *packed([h[pick], g[pick], low[pick], high[pick]])))
    names, kinds = ["bucket", "block", "h", "g", "low", "high"], [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)


def answered(table: pa.Table) -> pa.Table:
    """A bucket's keys that occur in more than one document, sent back to the blocks that hold them."""
    blocks = table.column("block").to_pylist()
    arrays = [[np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("h", np.uint64), ("g", np.uint64), ("low", np.int64), ("high", np.int64))]
    sizes = [len(x) for x in arrays[0]]
    h, g, low, high, place = least_by_key(*(np.concatenate(x) for x in arrays))
    rows, start = [], 0
    for block, n in zip(blocks, sizes, strict=True):
        mine = place[start : start + n]
        mine = mine[low[mine] < high[mine]]
        start += n
        if len(mine):
            rows.append((block, *packed([h[mine], g[mine], low[mine]])))
    kinds = [pa.int32(), *[pa.binary()] * 3]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["block", "h", "g", "low"])


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's answers, sorted by key."""
    h, g, low = (np.concatenate([*(np.frombuffer(x, kind) for x in table.column(c).to_pylist()), np.empty(0, kind)]) for c, kind in (("h", np.uint64), ("g", np.uint64), ("low", np.int64)))
    order = np.lexsort((g, h))
    return h[order], g[order], low[order]


def removals(block: Block, h: np.ndarray, g: np.ndarray, low: np.ndarray) -> pa.Table:
    """Per document of the block that loses words: id, h1, h2, n_removed, sha of the rest."""
    mine_h, mine_g, ids = block.whole_keys()
    allh, allg = np.concatenate([h, mine_h]), np.concatenate([g, mine_g])
    big = np.iinfo(np.int64).max
    lows = np.concatenate([low, np.full(len(mine_h), big)])
    *_, least, _, place = least_by_key(allh, allg, lows, lows)
    gone = least[place[len(h) :]] < ids if len(ids) else np.empty(0, bool)
    delta = np.zeros(block.offsets[-1] + 1, np.int64)
    np.add.at(delta, block.at[gone], 1)
    np.add.at(delta, block.at[gone] + block.length, -1)
    out = np.cumsum(delta)[:-1] > 0
    rows = []
    for k in np.unique(block.owner[gone]).tolist():
        a, b = block.offsets[k], block.offsets[k + 1]
        rest = b" ".join([w for w, x in zip(block.words[k], out[a:b].tolist(), strict=True) if not x])
        rows.append((k, int(out[a:b].sum()), hashlib.sha256(rest).hexdigest()))
    taken = block.keys.take(pa.array([r[0] for r in rows], pa.int64()))
    return pa.Table.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["id", "h1", "h2", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space)."""
    ship(docs.sparkSession)
    rows = docs.select(whole_ids(docs, id_col).alias("id"), docs[text_col].cast("string").alias("text"))
    all_rows = stored(summary(rows, length))
    first = all_rows.where((F.col("n_words") >= length) & F.col("id").isNotNull()).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    first = stored(first)
    # one row per different text: its smallest id; other ids with that text lose every word
    texts = all_rows.where(F.col("anchors").isNotNull()).join(first.withColumnRenamed("first", "id"), ["id", "h1", "h2"], "left_semi").select("id", "h1", "h2", "n_words", "anchors").dropDuplicates(["id", "h1", "h2"])
    texts = stored(texts)
    spread = texts.select("id", "h1", "h2", F.explode("anchors").alias("a"))
    shared = stored(spread.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("a"))
    known = stored(spread.join(shared, "a").groupBy("id", "h1", "h2").agg(F.collect_list("a").alias("anchors")))
    total = texts.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    if total:
        blocks = max(blocks, docs.sparkSession.sparkContext.defaultParallelism)
    # the texts of documents with a shared anchor, by block; equal rows once
    block_of = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    kept = small_join(rows.where(F.col("id").isNotNull()), known.select("id").distinct(), ["id"])
    held = stored(kept.mapInArrow(keyed, "id bigint, text string, h1 bigint, h2 bigint").join(known, ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"]).withColumn("block", block_of))
    buckets = max(blocks, -(-total // BUCKET_HASHES))
    by_block = lambda: held.groupBy("block")

    def halves(table: pa.Table) -> pa.Table:
        return sent_rows(table.column("block")[0].as_py(), *Block(table, length).half_keys(), buckets)

    def wholes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return sent_rows(0, *[np.empty(0, np.uint64)] * 2, np.empty(0, np.int64), buckets)
        block = Block(left, length)
        block.narrow(received(right)[0])
        return sent_rows(left.column("block")[0].as_py(), *block.whole_keys(), buckets)

    def ends(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]).empty_table()
        return removals(Block(left, length), *received(right))

    back = stored(by_block().applyInArrow(halves, SENT).groupBy("bucket").applyInArrow(answered, BACK))
    back = stored(by_block().cogroup(back.groupBy("block")).applyInArrow(wholes, SENT).groupBy("bucket").applyInArrow(answered, BACK))
    cut = by_block().cogroup(back.groupBy("block")).applyInArrow(ends, "id bigint, h1 bigint, h2 bigint, n_removed bigint, kept string")
    cut = stored(cut).withColumnRenamed("id", "cut_id")
    a, f, c = all_rows.alias("a"), first.alias("f"), cut.alias("c")
    same = lambda x: (F.col("a.h1") == F.col(f"{x}.h1")) & (F.col("a.h2") == F.col(f"{x}.h2"))
    out = a.join(f, same("f"), "left").join(c, (F.col("a.id") == F.col("c.cut_id")) & same("c"), "left")
    copy = F.coalesce(F.col("a.id") > F.col("f.first"), F.lit(False))
    return out.select(
        F.col("a.id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("a.n_words").alias("n_words"),
        F.when(copy, F.col("a.n_words")).otherwise(F.coalesce(F.col("c.n_removed"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce(F.col("c.kept"), F.col("a.sha"))).alias("kept_sha256"),
    )


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of the words in order."""
    for part in pieces(batches, "text"):
        lists, _ = split_texts(part.column("text"))
        h = np.array([np.frombuffer(hashlib.sha256(b" ".join(x)).digest()[:16], np.int64) for x in lists], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["id", "text", "h1", "h2"])


#: DuckDB SQL of remove_repeats over documents (50 words).
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
h AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, count(o.i) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY t.i) FILTER (o.i IS NULL), '')) AS s FROM t LEFT JOIN o USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(s, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
