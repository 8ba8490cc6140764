"""Token counts by heap-and-linked-list byte-pair merging, without producing token ids.

A BPE model of sentencepiece kind is a table piece -> rank. The text's symbols are its characters
(a character that is no piece counts as its UTF-8 bytes, which the model falls back to); the adjacent
pair whose joined piece has the lowest rank is merged, leftmost first, until no pair joins to a piece.
The count is the number of initial symbols less the merges.

A position between two characters that stand side by side in no piece can never be merged across, so the
text is cut there ("atoms"), and each different atom is merged once per worker and cached. The cut is
exact for any model of this kind; the cache is bounded. A model of another kind (with a normalizer, user-defined pieces
or scores instead of merges) is refused: it is tried on some thousand texts against its library first.

Defined results: null text counts as empty (0 bytes, 0 tokens); empty text 0 tokens; texts of many megabytes, also of one
word, are counted whole; rows are kept one to
one, repeated rows included, null ids stay null; an empty table gives an empty table; other columns are
ignored, also those named like results.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fernwork.llm.common import ship

#: Entries a worker's cache may hold before it starts afresh, and texts on which a model is tried.
CACHE, PROBES = 400_000, 2000
_shared: dict = {}


def load_pieces(path: str) -> tuple[dict[str, int], bool]:
    """Pieces with their ranks (0 first) of a sentencepiece BPE model, and whether it puts a space before the text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    order = sorted(usual, key=lambda i: (-sp.get_score(i), i))
    found = {sp.id_to_piece(i): k for k, i in enumerate(order)}, sp.encode("a", out_type=str) != ["a"]
    # a normalizer, user-defined pieces or another algorithm show in texts made of the pieces and of odd characters
    merger, r, names = Merger(*found), random.Random(1), list(found[0])
    odd = ["ﬁ", "Ａ", "½", "  ", " ", "é", "e\u0301", "漢", "🙂", "\u200b", "\t", "\n", "\x00", "▁", "<s>", "</s>", "<unk>", "<0x41>"]
    for k in range(PROBES):
        text = "".join((r.choice(odd) if r.random() < 0.2 else r.choice(names).replace("▁", " ")) for _ in range(1 + k % 12))
        if merger.count(text) != len(sp.encode(text)):
            raise ValueError(f"{path} isn't a plain BPE model: its library counts {text!r} otherwise")
    return found


class Merger(dict):
    """Counts tokens; as a dict it holds the counts of words (what stands between two spaces) seen so far."""

    def __init__(self, pieces: dict[str, int], prefix: bool = True):
        super().__init__()
        self.pieces, self.prefix, self.atoms = pieces, prefix, {}
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def merged(self, atom: str) -> int:
        """Initial symbols less merges."""
        pieces, n = self.pieces, len(atom)
        count = sum(1 if ch in pieces else len(ch.encode()) for ch in atom)
        if n < 2:
            return count
        symbol = list(atom)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := pieces.get(atom[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbol[i] or j < 0 or len(symbol[i]) + len(symbol[j]) != size:
                continue  # one of the two has changed since
            symbol[i] += symbol[j]
            symbol[j], count = "", count - 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := pieces.get(symbol[i] + symbol[k])) is not None:
                    heapq.heappush(heap, (r, i, len(symbol[i]) + len(symbol[k])))
            if (h := before[i]) >= 0 and (r := pieces.get(symbol[h] + symbol[i])) is not None:
                heapq.heappush(heap, (r, h, len(symbol[h]) + len(symbol[i])))
        return count

    def run(self, s: str) -> int:
        """Count of a string in which spaces are already the piece character."""
        total, start, pairs, atoms = 0, 0, self.pairs, self.atoms
        for i in range(1, len(s) + 1):
            if i == len(s) or s[i - 1 : i + 1] not in pairs:
                atom = s[start:i]
                if (n := atoms.get(atom)) is None:
                    if len(atoms) >= CACHE:
                        atoms.clear()
                    n = self.merged(atom)
                    if len(atom) <= 64:
                        atoms[atom] = n
                total, start = total + n, i
        return total

    def __missing__(self, word: str) -> int:
        n = self.run("▁" + word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.prefix and "▁" not in text and text[0] != " " and text[-1] != " " and "  " not in text:
            return sum(map(self.__getitem__, text.split(" ")))
        return self.run(("▁" if self.prefix else "") + text.replace(" ", "▁"))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). model: path of a sentencepiece BPE model."""
    spark = docs.sparkSession
    ship(spark)
    table, key = spark.sparkContext.broadcast(load_pieces(model)), model
    kept = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fernwork.llm import tokens

        merger = tokens._shared.get(key)
        if merger is None:
            merger = tokens._shared[key] = tokens.Merger(*table.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                n = [merger.count(x) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
