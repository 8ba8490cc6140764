"""Packing of tokenised documents into sequences of at most `size` tokens, by linear grouping.

Documents become pieces of token ids: a document's ids and one separator; only longer ones are cut, into
pieces of `size`. Which pieces go together depends on their lengths alone, so the plan is made from the
histogram of lengths (at most `size` counts, whatever the corpus holds) and then carried out over all pieces:

1. Lengths over size / LARGE are large. In order of length they are grouped in groups of equal cardinality, and each
   is rounded up to its group's longest: a few sizes remain. GROUPS numbers of groups are tried, as far as that can
   help, and the plan with the fewest sequences is taken.
2. The configurations of these sizes are optimised: the linear program over all of them is solved by column
   generation, whose pricing is an unbounded knapsack. Its solution is rounded down; what it leaves over is
   packed best-fit in order of length.
3. Actual pieces take the places of the rounded sizes, longest first, which leaves room beside them.
4. The small pieces go, longest first, where they fit best; new sequences open when none fits.

Sequences with equal contents so far are handled as one class, so steps 3 and 4 cost as many operations as
there are classes, not pieces. A piece finds its place from its length and its rank among pieces of that
length; ranks are counted per salted part of a length and added up, so a length that a third of all pieces
share is spread over many tasks.

Defined results: a null text counts as empty and becomes a piece that holds the separator alone; null ids stay
null; a text of many megabytes is tokenised whole and cut into as many pieces as it needs; repeated rows are packed as
often as they occur; ties between pieces of equal length may fall either way,
but a plan is the same for the same lengths; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernwork.llm.common import ship, stored
from fernwork.llm.hashing import pieces as slices

#: Numbers of groups of large lengths that are tried, and the part of a sequence's size over which a length is large.
GROUPS, LARGE = (24, 64, 160), 8
#: Steps of column generation at most, the gain below which it ends where there are many groups, and how near to the
#: least possible number of sequences a plan needs no better one.
STEPS, NEAR, ENOUGH = 3000, 0.0005, 0.001
#: Pieces of one length that are ranked in one task, at about which another part of that length is opened.
RANKED = 50_000
#: Entries a worker's cache of encoded words may hold before it starts afresh.
CACHE = 100_000
#: Bytes of text encoded at a time.
SLICE = 8_000_000
#: What a tokenizer's file says whose texts may be encoded word by word.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_shared: dict = {}


class Encoder:
    """Token ids of texts by way of their chunks between ASCII white space; each different chunk is encoded once.

    Holds for tokenizers with the KNOWN normalizer and pre-tokenizer, which never join what white space separates and
    drop the white space itself; with any other, texts are encoded whole. Chunks of ASCII and plain Latin letters, whose lower case is a letter for a letter, are
    cut further, into the words of the pre-tokenizer's pattern, and words that are new go to it together. What a
    chunk consists of is kept in a cache of two generations, so what is in use survives when it is full."""

    PLAIN = re.compile("[!-~À-ÖØ-öø-įıĲ-ſ]+")
    SIMPLE = r"^[\t-\r -&(-~À-ÖØ-öø-įı-ſ]*$"
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunks, self.words = Tokenizer.from_str(spec), {}, {}
        self.old_chunks, self.old_words = {}, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(spec)
        special = all(t["content"].startswith("<|") and not t["content"].split()[1:] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made["added_tokens"])
        self.fast = special and made["model"]["type"] == "BPE" and not made["model"].get("dropout") and all(made[k] == v for k, v in KNOWN.items())

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words of the pre-tokenizer's pattern, a thousand at a time."""
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, cut = np.array(got.ids, "<u4").tobytes(), np.searchsorted(np.array(got.word_ids), np.arange(len(some) + 1)).tolist()
            self.words.update((w, ids[4 * cut[i] : 4 * cut[i + 1]]) for i, w in enumerate(some))

    def known(self, different: list[str]) -> list[bytes]:
        """The ids of different chunks, as little-endian 32-bit bytes."""
        if len(self.chunks) >= CACHE:
            self.chunks, self.old_chunks = {}, self.chunks
        if len(self.words) >= CACHE:
            self.words, self.old_words = {}, self.words
        chunks, words, cut = self.chunks, self.words, {}
        plain, pattern, old = self.PLAIN.fullmatch, self.WORDS.findall, self.old_chunks.get
        for chunk in different:
            if chunk not in chunks:
                if (had := old(chunk)) is not None:
                    chunks[chunk] = had
                elif plain(chunk) and "<|" not in chunk:
                    cut[chunk] = pattern(chunk.lower())
                else:
                    chunks[chunk] = self.ids(chunk)
        new = set().union(*cut.values()).difference(words)
        words.update((w, self.old_words[w]) for w in new & self.old_words.keys())
        self.learn([w for w in new if w not in words])
        for chunk, parts in cut.items():
            chunks[chunk] = words[parts[0]] if len(parts) == 1 else b"".join([words[w] for w in parts])
        return [chunks[x] for x in different]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts side by side, `end` after each text, and the texts' offsets."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.fast:
            lists = [np.array([*self.tokenizer.encode(x, add_special_tokens=False).ids, end], np.uint32) for x in texts.to_pylist()]
            return np.concatenate([*lists, np.empty(0, np.uint32)]), np.cumsum([0, *map(len, lists)])
        # in texts of plain characters alone, words and runs of punctuation are parted beforehand
        simple = pc.and_(pc.match_substring_regex(texts, self.SIMPLE), pc.invert(pc.match_substring(texts, "<|")))
        parted = pc.replace_substring_regex(pc.utf8_lower(texts), r"([!-/:-@\[-`{-~]+)", r" \1 ")
        lists = pc.ascii_split_whitespace(pc.if_else(simple, parted, texts))
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        different = coded.dictionary.to_pylist()
        parts = [*self.known(different), np.array([end], "<u4").tobytes()]
        ids, size = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin = np.cumsum(size) - size
        tokens = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets[1:], len(different))
        many = size[tokens]
        ends = np.cumsum(many)
        out = ids[np.repeat(begin[tokens] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[np.concatenate([[0], offsets[1:] + np.arange(1, len(offsets))])]
        return out, cut


def tokenised(docs: DataFrame, spec: str, size: int, end: int) -> DataFrame:
    """Rows (id, text): a row per piece with piece, start, length, ids_crc32."""
    key, sent = hash(spec), docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fernwork.llm import packing

        encoder = packing._shared.get(key)
        if encoder is None:
            encoder = packing._shared[key] = packing.Encoder(sent.value)
        for part in slices(batches, "text", SLICE):
            ids, cut = encoder.encode(part.column("text"), end)
            owner, rows = [], []
            for k in range(part.num_rows):
                a, n = int(cut[k]), int(cut[k + 1] - cut[k])
                for start in range(0, n, size):
                    long = min(size, n - start)
                    owner.append(k)
                    rows.append((start // size, start, long, zlib.crc32(ids[a + start : a + start + long])))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner, pa.int64())), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_value(value: np.ndarray, sizes: list[int], size: int) -> tuple[float, list[int]]:
    """Unbounded knapsack: the configuration of sizes within `size` that is worth most. One size is added at a time, in
    each of the numbers that fit; large sizes fit few times."""
    best = np.zeros(size + 1)
    taken = np.zeros((len(sizes), size + 1), np.int16)
    for k, (s, v) in enumerate(zip(sizes, value.tolist(), strict=True)):
        if v <= 0:
            continue
        new = best.copy()
        for many in range(1, size // s + 1):
            worth = best[: size + 1 - many * s] + many * v
            up = worth > new[many * s :] + 1e-12
            new[many * s :][up] = worth[up]
            taken[k, many * s :][up] = many
        best = new
    counts, room = [0] * len(sizes), size
    for k in range(len(sizes) - 1, -1, -1):
        counts[k] = int(taken[k, room])
        room -= counts[k] * sizes[k]
    return float(best[size]), counts


def configurations(sizes: list[int], demand: list[int], size: int) -> list[tuple[list[int], int]]:
    """Configurations with how often each is used: the linear program's solution, rounded down."""
    n = len(sizes)
    inverse = np.diag([1.0 / (size // s) for s in sizes])
    columns = np.diag([float(size // s) for s in sizes])
    x = np.array(demand, float) / np.diag(columns)
    for turn in range(STEPS):
        if turn % 50 == 49:  # rounding errors of the updates
            inverse = np.linalg.inv(columns)
        price = inverse.sum(axis=0)
        worth, counts = best_value(np.maximum(price, 0), sizes, size)
        if worth <= 1 + 1e-7 or len(sizes) > GROUPS[0] and x.sum() * (1 - 1 / worth) < x.sum() * NEAR:
            break  # the bound x / worth shows that there is little left to gain
        way = inverse @ np.array(counts, float)
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.full(n, np.inf)
        ratio[up] = x[up] / way[up]
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        columns[:, out] = counts
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    return [([round(c) for c in columns[:, k]], int(x[k] + 1e-9)) for k in range(n) if int(x[k] + 1e-9)]


class Plan:
    """Places of pieces by (length, rank): rows (length, first rank, rank after the last, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], size: int, groups: int = GROUPS[0]):
        self.size, self.groups, self.rows, self.sequences = size, groups, [], 0
        self.left, self.used = dict(counts), dict.fromkeys(counts, 0)
        self.open: dict[int, list[list[int]]] = {}  # room left: classes of [first sequence, sequences]
        self.large()
        self.rest()

    def put(self, length: int, first: int, many: int, each: int, offset: int) -> None:
        """The next pieces of a length go to `many` sequences, `each` into each."""
        a = self.used[length]
        self.rows.append((length, a, a + many * each, first, each, offset))
        self.used[length] += many * each
        self.left[length] -= many * each

    def large(self) -> None:
        lengths = sorted((n for n, c in self.left.items() if c and n * LARGE > self.size), reverse=True)
        total = sum(self.left[n] for n in lengths)
        if not total:
            return
        # equal cardinality; a group holds runs of lengths, longest first, and a length may be split over groups
        groups, room, share = [], 0, -(-total // min(self.groups, total))
        for n in lengths:
            c = self.left[n]
            while c:
                if not room:
                    groups.append([])
                    room = share
                take = min(c, room)
                groups[-1].append([n, take])
                room, c = room - take, c - take
        by_size: dict[int, list[list[int]]] = {}
        for g in groups:
            by_size.setdefault(g[0][0], []).extend(g)  # groups with one size are one
        sizes = list(by_size)
        for counts, many in configurations(sizes, [sum(c for _, c in by_size[s]) for s in sizes], self.size):
            first, classes = self.sequences, [[self.sequences, many, 0]]
            self.sequences += many
            for s, k in zip(sizes, counts, strict=True):
                for _ in range(k):
                    classes = self.slot(classes, by_size[s])
            for base, n, filled in classes:
                self.open.setdefault(self.size - filled, []).append([base, n])
            assert first + many == self.sequences

    def slot(self, classes: list[list[int]], runs: list[list[int]]) -> list[list[int]]:
        """One more piece of a group into each sequence of the classes, as far as there are any."""
        out = []
        for base, many, filled in classes:
            while many:
                while runs and not runs[0][1]:
                    runs.pop(0)
                if not runs:
                    out.append([base, many, filled])
                    break
                n, take = runs[0][0], min(many, runs[0][1])
                self.put(n, base, take, 1, filled)
                runs[0][1] -= take
                out.append([base, take, filled + n])
                base, many = base + take, many - take
        return out

    def rest(self) -> None:
        """Best fit, longest first: each piece goes where the least room is left."""
        import bisect

        rooms = sorted(self.open)
        for n in sorted((n for n, c in self.left.items() if c), reverse=True):
            while c := self.left[n]:
                at = bisect.bisect_left(rooms, n)
                if at == len(rooms):
                    each = self.size // n
                    many = max(1, c // each)
                    room, classes = self.size, [[self.sequences, many]]
                    self.sequences += many
                else:
                    room = rooms.pop(at)
                    classes = self.open.pop(room)
                each = room // n
                for k, (base, many) in enumerate(classes):
                    c = self.left[n]
                    full, over = min(many, c // each), 0
                    if full:
                        self.put(n, base, full, each, self.size - room)
                        self.add(rooms, room - full // full * each * n, base, full)
                    if full < many and (over := self.left[n]) and over < each:
                        self.put(n, base + full, 1, over, self.size - room)
                        self.add(rooms, room - over * n, base + full, 1)
                        full += 1
                    if full < many:
                        self.add(rooms, room, base + full, many - full)
                    if not self.left[n]:
                        for b, m in classes[k + 1 :]:
                            self.add(rooms, room, b, m)
                        break

    def add(self, rooms: list[int], room: int, base: int, many: int) -> None:
        import bisect

        if room:
            if room not in self.open:
                bisect.insort(rooms, room)
            self.open.setdefault(room, []).append([base, many])


def best_plan(counts: dict[int, int], size: int) -> Plan:
    """The plan with the fewest sequences among numbers of groups: few ones leave room by rounding that small pieces
    fill, many ones leave little where there are few small pieces. Ends once a plan is as good as the bound, nearly."""
    least = sum(n * c for n, c in counts.items()) / size
    best = None
    for groups in GROUPS:
        plan = Plan(dict(counts), size, groups)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= least * (1 + ENOUGH) + 1:
            break
    return best


def placed(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Adds sequence_id and offset to rows with length and rank."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    sent = ranked.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        key = (rows[:, 0] << np.int64(44)) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << np.int64(44)) + rank, "right") - 1
            k, each = rank - rows[at, 1], rows[at, 4]
            out = [rows[at, 3] + k // each, rows[at, 5] + k % each * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset. tokenizer: path of a tokenizers file."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    made = stored(tokenised(rows, Path(tokenizer).read_text(), size, end))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `size` rows at most
    total = sum(counts.values())
    salts = max(64, -(-total // RANKED))
    order = [F.col(c) for c in ("id", "piece", "ids_crc32")]
    salted = made.withColumn("salt", F.pmod(F.xxhash64("id", "piece", F.lit("rank")), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)))
    ranked = local.join(before, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local") - 1).alias("rank"))
    return placed(ranked, best_plan(counts, size)).withColumnRenamed("id", id_col)
