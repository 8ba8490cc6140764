"""Word and window hashes in numpy, for the operators whose workers run Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Different words a worker's cache may hold before it starts afresh.
CACHE = 200_000
#: Bytes of text hashed at a time; a longer text is a piece of its own.
PIECE = 3_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def windows(w: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """Hash of each run of `length` words, by its first word; equal runs have equal hashes anywhere."""
    n = len(w)
    if n < length:
        return np.empty(0, np.uint64)
    b = _BASES[base]
    up = np.full(n, b, np.uint64)
    up[0] = 1
    down = np.full(n, pow(b, -1, 1 << 64), np.uint64)
    down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w * np.cumprod(up), out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * np.cumprod(down)[: n - length + 1] + np.uint64(length))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values."""
    have, least = 1, x
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `size` bytes of the column."""
    for batch in batches:
        lengths = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64) if batch.num_rows else np.empty(0, np.int64)
        start, total = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if total + n > size and k > start:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a worker may idle beside others


def split_texts(column: pa.Array, lower: bool = False) -> tuple[list[list[bytes]], np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text (A-Z lower-cased if asked; null: none) and the offsets of their texts."""
    texts = column.cast(pa.binary()).to_pylist()
    # bytes.split() cuts at these very characters, and bytes.lower() changes A-Z alone
    lists = [[] if t is None else (t.lower() if lower else t).split() for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return lists, offsets


def encoded_words(column: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of the texts, the words' places among them one after the other, and the texts' offsets."""
    texts = pc.fill_null(column.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)  # cuts at U+0009..U+000D and space
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    full = pc.binary_length(flat).to_numpy() > 0
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets
