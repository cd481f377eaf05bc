"""Vectorised text primitives shared by the batch operators.

Every function takes one Arrow batch of texts and works on its flat UTF-8
buffer with numpy, so the cost per word is a handful of array passes and no
Python object is made per word.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
TEXT_BLOCK = 8 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and n + 1 offsets."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def ascii_lower(flat: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    upper = (flat >= 65) & (flat <= 90)
    return flat + (upper.view(np.uint8) << np.uint8(5))


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch, by byte position in ``flat``."""

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n_docs + 1: where each document's words begin

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words those numbers point to."""
        lengths = self.ends - self.starts
        at = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        body = self.flat[~((self.flat == 32) | ((self.flat >= 9) & (self.flat <= 13)))]
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    flat, offsets = utf8_buffer(texts)
    if lower:
        flat = ascii_lower(flat)
    inked = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    before = np.empty(len(inked), bool)
    if len(inked):
        before[0] = False
        before[1:] = inked[:-1]
        begin = offsets[:-1]
        before[begin[begin < len(inked)]] = False  # a text begins anew
    starts = np.flatnonzero(inked & ~before)
    after = np.zeros(len(inked), bool)
    if len(inked):
        after[:-1] = inked[1:] & before[1:]
    ends = np.flatnonzero(inked & ~after) + 1
    return Words(flat, starts, ends, np.searchsorted(starts, offsets))


def hash_words(words: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of each distinct word."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h.copy()
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def shingle_hashes(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each run of k words, and n_docs + 1 offsets.

    A document of fewer than k words, but at least one, has its whole sequence
    as the only shingle; one without words has none.  Hashes depend on the
    words and their order alone, so equal runs agree across batches.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint64)
    with np.errstate(over="ignore"):
        n = len(word_hash) - k + 1
        if n > 0:
            rolled = np.zeros(n, np.uint64)
            for j in range(k):
                rolled = rolled * MIX + word_hash[j : j + n]
            rolled = mix(rolled)
            long = counts >= k
            into = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(first[:-1], sizes)
            pick = np.repeat(long, sizes)
            out[pick] = rolled[into[pick]]
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            h = np.zeros(1, np.uint64)
            for w in word_hash[first[d] : first[d + 1]]:
                h = h * MIX + w
            out[offsets[d]] = mix(h + np.uint64(counts[d]))[0]
    return out, offsets


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, then those of the next run, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at - starts, lengths)


def text_blocks(texts: pa.Array, limit: int = TEXT_BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    sizes = pc.binary_length(texts.cast(pa.large_string()).fill_null("")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose task's end gives memory that is no longer used back to the system.

    Python workers outlive their tasks, so what one stage has freed but kept
    would count against the executor while others run.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return whole
