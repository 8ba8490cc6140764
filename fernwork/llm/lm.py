"""Scores of texts under a log-bilinear neural language model trained with noise-contrastive estimation.

Training documents are those whose id, as text, has a crc32 that isn't `held` modulo `parts`. Tokens are lower-case
(A-Z) words and one end per text.

* Words are counted over all training documents. The base score is add-one unigram probability.
* The model predicts a token's class from the classes of the two tokens before it, and the token within its class
  by add-one frequency (an unseen word is one further token of its class). The most frequent words and the end
  are classes of their own; other words fall in classes by their last two bytes. Classes are CLASSES in all.
* The context vector is the sum of the two context classes' vectors, each scaled by its position's weights; a
  class's score is its dot product with the class's vector plus a bias (log-bilinear). Every task trains on its
  own training texts by minibatches with noise drawn from the classes' frequencies; the tasks' parameters are
  averaged by their tokens, and a second round starts from the average.
* For scoring, one batched matrix product over all contexts and classes gives the scores, which are normalised;
  so the probabilities of all tokens after any context sum to one.

Counts of the TOP most frequent words, about, travel to the workers; the other words of a text meet their counts
in a shuffle by word. Every task goes over its texts the same number of times, whatever their number. Its parameters
are packed in one row, and rows are added up in a tree of tasks. As a task draws its own noise, scores depend on how the
texts are partitioned, slightly.

Defined results: null, empty and blank texts are one token, the end; a null id counts as the empty text for the
split; rows are kept one to one, repeated rows included; with no training documents every class is equally likely
and counts are 0; ties in frequency are broken by hash; an empty table gives an empty table; other columns are
ignored, also those named like results; texts of many megabytes are read whole. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.llm.common import ship, stored
from fernwork.llm.hashing import encoded_words, pieces, word_hashes

CLASSES, OWN, SIZE = 256, 160, 24
#: Words whose counts are sent to workers, at most; minibatch, noise samples of a batch, rounds, passes over the texts in a round.
TOP, BATCH, NOISE, ROUNDS, EPOCHS = 200_000, 2048, 128, 2, 1
#: Tasks' parameters that are added up by one task.
FAN = 64
#: Bytes of text handled at a time.
SLICE = 8_000_000
END = 0


def suffix(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big")


def counted(rows: DataFrame) -> DataFrame:
    """rows (text): (h, suffix, n) of all words. A slice of texts gives each of its words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", SLICE):
            words, at, _ = encoded_words(part.column("text"), lower=True)
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words).view(np.int64)), pa.array(map(suffix, words), pa.int32()), pa.array(np.bincount(at, minlength=len(words)))], names=["h", "suffix", "n"])

    return rows.select("text").mapInArrow(run, "h bigint, suffix int, n bigint").groupBy("h").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


class Vocabulary:
    """What workers need of the counts: the frequent words, the classes, the classes' totals."""

    def __init__(self, counts: DataFrame, texts: int):
        self.texts = texts
        level = F.floor(F.log2("n") * 32)
        levels = sorted(((r["level"], r["w"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("w")).collect()), reverse=True)
        least, held = None, 0
        for at, many in levels:
            if held + many > TOP:
                break
            least, held = at, held + many
        top = [] if least is None else counts.where(level >= least).collect()
        top = sorted(((r["n"], r["h"], r["suffix"]) for r in top), key=lambda x: (-x[0], x[1]))
        self.top = {h & (2**64 - 1): k + 1 for k, (_, h, _) in enumerate(top)}
        self.top_counts = np.array([0, *(n for n, _, _ in top)], np.int64)
        sums = {r["suffix"]: [r["n"], r["v"]] for r in counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # 65,536 rows at most
        for n, _, s in top[:OWN]:
            sums[s][0] -= n
            sums[s][1] -= 1
        self.tokens = sum(n for n, _ in sums.values()) + sum(n for n, _, _ in top[:OWN]) + texts
        self.distinct = sum(v for _, v in sums.values()) + min(OWN, len(top)) + (texts > 0)
        first = OWN + 1
        by_sum = sorted(sums, key=lambda s: (-sums[s][0], s))
        self.suffixes = {s: first + 1 + k for k, s in enumerate(by_sum[: CLASSES - first - 1])}
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        n[END] = texts
        for k, (c, _, _) in enumerate(top[:OWN]):
            n[k + 1] = c
        for s, (c, w) in sums.items():
            n[self.suffixes.get(s, first)] += c
            v[self.suffixes.get(s, first)] += w
        self.log_total = np.where(np.arange(CLASSES) > OWN, np.log10(n + v + 1), 0.0)  # of the classes with more than one word
        share = n + 1.0
        self.share = (share / share.sum()).astype(np.float64)


def coded(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """rows (id, held_out, text), read once for training and scoring: n_tokens, known, the sums of log counts (base) and
    of log frequencies within classes (within) of all but infrequent words, those words' hashes, the words' classes."""
    sent = rows.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        log_count = np.log10(v.top_counts + 1.0)
        end = math.log10(v.texts + 1)
        for part in pieces(batches, "text", SLICE):
            words, at, offsets = encoded_words(part.column("text"), lower=True)
            hashes = word_hashes(words)
            place = np.fromiter((v.top.get(h, 0) for h in hashes.tolist()), np.int64, len(words))
            ends = np.fromiter((v.suffixes.get(suffix(w), OWN + 1) for w in words), np.int64, len(words))
            kind = np.where((place > 0) & (place <= OWN), place, ends)
            inside = np.where(kind > OWN, log_count[place] - v.log_total[kind], 0.0)
            text = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            sums = [np.bincount(text, x[at], part.num_rows) for x in (log_count[place], inside, (place > 0).astype(np.float64))]
            rare = np.flatnonzero(place[at] == 0)
            cut = np.searchsorted(rare, offsets)
            classes = kind[at].astype(np.uint8).tobytes()
            n = np.diff(offsets) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), part.column("held_out"), pa.array(n), pa.array(sums[2].astype(np.int64) + (v.texts > 0)), pa.array(sums[0] + end), pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hashes[at[rare]].view(np.int64))), pa.array([classes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                ],
                names=["id", "held_out", "n_tokens", "known", "base", "within", "rare", "classes"],
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, known bigint, base double, within double, rare array<bigint>, classes binary")


def in_line(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all texts, each with two ends before it and one after; which are tokens; where texts' tokens begin."""
    texts = column.to_pylist()
    flat = np.frombuffer(b"".join([x for t in texts for x in (b"\0\0", t, b"\0")]), np.uint8).astype(np.int64)
    starts = np.cumsum([0, *(len(t) + 3 for t in texts[:-1])]) if texts else np.empty(0, np.int64)
    real = np.ones(len(flat), bool)
    real[starts] = real[starts + 1] = False
    return flat, real, starts


def start(share: np.ndarray) -> np.ndarray:
    """Parameters before training: small random vectors, and the classes' log frequencies as biases."""
    r = np.random.default_rng(5)
    return np.concatenate([r.normal(0, 0.1, 2 * CLASSES * SIZE), np.ones(2 * SIZE), np.log(share)]).astype(np.float32)


def parts_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views: context vectors, class vectors, the two positions' weights, biases."""
    a = CLASSES * SIZE
    return p[:a].reshape(CLASSES, SIZE), p[a : 2 * a].reshape(CLASSES, SIZE), p[2 * a : 2 * a + 2 * SIZE].reshape(2, SIZE), p[2 * a + 2 * SIZE :]


_COLUMNS = np.arange(SIZE)


def scattered(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values' sums by row."""
    return np.bincount((rows[:, None] * SIZE + _COLUMNS).ravel(), values.ravel(), CLASSES * SIZE).reshape(CLASSES, SIZE).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; far negative values overflow to 0."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation by minibatches with Adagrad steps."""

    def __init__(self, p: np.ndarray, share: np.ndarray, seed: int):
        self.p, self.square = p.copy(), np.full(len(p), 1e-3, np.float32)
        self.random, self.share = np.random.default_rng(seed), share
        self.offset = (np.log(NOISE) + np.log(share)).astype(np.float32)

    def batch(self, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> None:
        q, r, pos, b = parts_of(self.p)
        grad = np.zeros_like(self.p)
        dq, dr, dpos, db = parts_of(grad)
        noise = self.random.choice(CLASSES, NOISE, p=self.share)
        q1, q2 = q[c1], q[c2]
        context = q1 * pos[0] + q2 * pos[1]
        rw = r[w]
        good = sigmoid(np.einsum("ij,ij->i", context, rw) + b[w] - self.offset[w]) - 1
        rn = r[noise]
        bad = context @ rn.T
        bad += b[noise] - self.offset[noise]
        bad = sigmoid(bad)
        back = good[:, None] * rw + bad @ rn
        dr += scattered(w, good[:, None] * context)
        np.add.at(dr, noise, bad.T @ context)
        db += np.bincount(w, good, CLASSES).astype(np.float32)
        np.add.at(db, noise, bad.sum(axis=0))
        dq += scattered(c1, back * pos[0]) + scattered(c2, back * pos[1])
        dpos[0], dpos[1] = (back * q1).sum(axis=0), (back * q2).sum(axis=0)
        grad /= len(w)
        self.square += grad * grad
        self.p -= 0.1 * grad / np.sqrt(self.square)

    def learn(self, classes: np.ndarray, real: np.ndarray) -> int:
        at = np.flatnonzero(real)
        self.random.shuffle(at)
        for k in range(0, len(at), BATCH):
            i = at[k : k + BATCH]
            self.batch(classes[i - 2], classes[i - 1], classes[i])
        return len(at)


def trained(rows: DataFrame, v: Vocabulary) -> np.ndarray:
    """Parameters after ROUNDS rounds of training on all rows (classes)."""
    spark = rows.sparkSession
    share, p = v.share, start(v.share)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer, count = Trainer(sent.value, share, 1000 * TaskContext.get().partitionId() + turn), 0
            for part in pieces(batches, "classes", SLICE // 8):
                flat, real, _ = in_line(part.column("classes"))
                for _ in range(EPOCHS):
                    many = trainer.learn(flat, real)
                count += many
            if count:
                yield summed([(count, trainer.p.astype(np.float64) * count)], TaskContext.get().partitionId())

        sums = stored(rows.select("classes").mapInArrow(run, SUMS))
        tasks = sums.count()
        # the tasks' vectors are added up as they are, in a tree of FAN branches, so neither a task nor the driver gets many
        while tasks > FAN:
            tasks = -(-tasks // FAN)
            sums = sums.repartition(tasks, "task").mapInArrow(added, SUMS)
        got = sums.collect()
        if got:
            p = (sum(np.frombuffer(r["p"]) for r in got) / sum(r["tokens"] for r in got)).astype(np.float32)
    return p


#: Rows of summed parameters: whose task's, of how many tokens, and the parameters times the tokens as packed doubles.
SUMS = "task int, tokens bigint, p binary"


def summed(parts: list[tuple[int, np.ndarray]], task: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([sum(n for n, _ in parts)], pa.int64()), pa.array([sum(x for _, x in parts).tobytes()], pa.binary())], names=["task", "tokens", "p"])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a task as one."""
    from pyspark import TaskContext

    total, many = None, 0
    for batch in batches:
        for n, x in zip(batch.column("tokens").to_pylist(), batch.column("p").to_pylist(), strict=True):
            x = np.frombuffer(x)
            total, many = x if total is None else total + x, many + n
    if many:
        yield summed([(many, total)], TaskContext.get().partitionId())


def log_table(p: np.ndarray) -> np.ndarray:
    """log10 probability of each class after each pair of classes, as [older * CLASSES + newer, class]."""
    q, r, pos, b = parts_of(p)
    out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
    new = q * pos[0]
    for older in range(CLASSES):
        s = (new + q[older] * pos[1]) @ r.T + b
        top = s.max(axis=1, keepdims=True)
        out[older * CLASSES : (older + 1) * CLASSES] = (s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))) / math.log(10)
    return out


def scored(texts: DataFrame, p: np.ndarray) -> DataFrame:
    """coded texts with rid: their columns but for classes and rare, and model, the sum of the classes' log probabilities."""
    sent = texts.sparkSession.sparkContext.broadcast(p)
    kept = [c for c in texts.columns if c not in ("classes", "rare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = log_table(sent.value).reshape(-1)
        for part in pieces(batches, "classes", SLICE // 8):
            flat, real, starts = in_line(part.column("classes"))
            value = np.zeros(len(flat))
            at = np.flatnonzero(real)
            value[at] = table[(flat[at - 2] * CLASSES + flat[at - 1]) * CLASSES + flat[at]]
            sums = np.add.reduceat(value, starts) if len(starts) else value
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sums)], names=[*kept, "model"])

    fields = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept)
    return texts.select(*kept, "classes").mapInArrow(run, f"{fields}, model double")


def score(docs: DataFrame, parts: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    ship(spark)
    out = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % parts == held
    rows = docs.select(docs[id_col].alias("id"), out.alias("held_out"), docs[text_col].cast("string").alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = stored(counted(train))
    v = Vocabulary(counts, train.count())
    texts = stored(coded(rows, v).withColumn("rid", F.monotonically_increasing_id()))
    p = trained(texts.where("NOT held_out"), v)
    rare = texts.select("rid", F.explode("rare").alias("h")).join(counts.select("h", "n"), "h").groupBy("rid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    df = scored(texts, p).join(rare, "rid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    scale = math.log10(v.tokens + v.distinct + 1)
    return df.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (F.col("model") + F.col("within") + logs).alias("score"),
    )
