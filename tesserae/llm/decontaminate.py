"""Documents that hold benchmark items.

1. Each item has a SimHash fingerprint of its word shingles.  A text is read in
   windows of the items' own sizes, one size after another, and a window's
   fingerprint comes from running sums of its shingles' bits.  Windows that hold
   too few shingles of any item of their size to reach the threshold, in
   whatever order, are not fingerprinted: no item could match them.
2. A multi-index over blocks of bits gives the items near a window.  With m
   blocks and radius r, fingerprints within r differ in at most floor(r / m)
   bits in some block, so looking up each block at that tolerance finds all
   items within the radius, and the whole distance is taken of those alone.
3. Candidates are verified by their exact weighted-shingle similarity, the sum
   of the smaller weights over the sum of the larger, a shingle's weight being
   its number of occurrences.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.llm.textcore import MIX, gather_runs, hash_words, mix, shingle_hashes, text_blocks, tidied, words_of

BLOCKS, WIDTH = 4, 16
#: Bytes of items in one broadcast, of all broadcasts that one scan of the documents may use, and of items that a worker keeps compiled.
BLOCK_BYTES, SCAN_BYTES, COMPILED_BYTES = 8 << 20, 1 << 30, 32 << 20
#: Windows fingerprinted at once, and pairs of a window and a block's value looked up at once.
WINDOWS, PAIRS = 50_000, 2_000_000


def fingerprint(shingles: np.ndarray) -> np.uint64:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles), bitorder="little").view("<u8")[0]


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of windows [start, end) of shingles, and a hash of each window's shingles that forgets their order."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    over = 2 * (sums[ends] - sums[starts]) > (ends - starts)[:, None]
    with np.errstate(over="ignore"):
        bags = np.append(np.uint64(0), np.cumsum(mix(shingles)))
        return np.packbits(over, axis=1, bitorder="little").reshape(-1).view("<u8"), bags[ends] - bags[starts]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingle hashes."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / (len(a) + len(b) - shared)


def run_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """The hash that ``shingle_hashes`` gives a whole text of n < k words, for each run of n words."""
    out = np.zeros(max(0, len(word_hash) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * MIX + word_hash[j : j + len(out)]
        return mix(out + np.uint64(n))


class HammingIndex:
    """All of a set of fingerprints within a radius of a given one, by multi-index lookups over blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.least = prints, radius, radius // BLOCKS
        self.patterns = np.asarray([sum(1 << b for b in c) for n in range(min(self.least, WIDTH) + 1) for c in combinations(range(WIDTH), n)], np.uint64)
        self.tables = []
        for b in range(BLOCKS):
            own = self.block(prints, b)
            order = np.argsort(own, kind="stable")
            values, first = np.unique(own[order], return_index=True)
            self.tables.append((values, np.append(first, len(own)), order))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(WIDTH * b)) & np.uint64((1 << WIDTH) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, place in the set) of all pairs within the radius, in order."""
        queries, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b, (values, first, order) in enumerate(self.tables):
            if not len(values):
                continue
            # few values: each is compared; many: each pattern of flipped bits is looked up
            width = min(len(values), len(self.patterns))
            for i in range(0, len(prints), max(1, PAIRS // width)):
                own = self.block(prints[i : i + max(1, PAIRS // width)], b)
                if len(values) <= len(self.patterns):
                    q, v = np.nonzero(np.bitwise_count(own[:, None] ^ values) <= self.least)
                else:
                    asked = own[:, None] ^ self.patterns
                    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
                    q, n = np.nonzero(values[at] == asked)
                    v = at[q, n]
                sizes = first[v + 1] - first[v]
                q, item = np.repeat(q + i, sizes), order[gather_runs(first[v], sizes)]
                near = np.bitwise_count(prints[q] ^ self.prints[item]) <= self.radius
                queries.append(q[near])
                found.append(item[near])
        pairs = np.unique(np.stack([np.concatenate(queries), np.concatenate(found)]), axis=1)
        return pairs[0], pairs[1]


class Benchmark:
    """Compiled items: shingles, fingerprints and, for each size of items, an index."""

    def __init__(self, ids: list, texts: list[str | None], k: int, threshold: float, radius: int):
        self.ids, self.k, self.threshold = ids, k, threshold
        w = words_of(pa.array(texts, pa.string()))
        codes, words = w.codes() if len(w.starts) else (np.empty(0, np.int64), pa.array([], pa.large_binary()))
        hashes, at = shingle_hashes(hash_words(words)[codes] if len(codes) else np.empty(0, np.uint64), w.first, k)
        self.size, self.hashes, self.at = w.counts, hashes, at
        self.short: dict[int, dict[int, list[int]]] = {}
        for n in np.flatnonzero((self.size > 0) & (self.size < k)).tolist():  # an item without words is in no document
            self.short.setdefault(int(self.size[n]), {}).setdefault(int(hashes[at[n]]), []).append(n)
        self.print = np.zeros(len(ids), np.uint64)
        #: for each size: its items, the sorted shingles that any of them holds, and the index of their fingerprints
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, HammingIndex]] = {}
        for size in np.unique(self.size[self.size >= k]).tolist():
            items = np.flatnonzero(self.size == size)
            self.print[items] = [fingerprint(self.shingles(n)) for n in items.tolist()]
            self.sizes[size] = items, np.unique(np.concatenate([self.shingles(n) for n in items.tolist()])), HammingIndex(self.print[items], radius)
        self.known = np.unique(np.concatenate([known for _, known, _ in self.sizes.values()])) if self.sizes else np.empty(0, np.uint64)

    def shingles(self, n: int) -> np.ndarray:
        return self.hashes[self.at[n] : self.at[n + 1]]

    def within(self, fp: int) -> set[int]:
        """All items of k words or more whose fingerprints lie within the radius."""
        return {int(items[n]) for items, _, index in self.sizes.values() for n in index.near(np.asarray([fp], np.uint64))[1]}

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, float]]:
        """(row, item, first word, similarity): the best window of each item a text holds; the earliest among equals."""
        w = words_of(texts)
        if not len(w.starts):
            return
        codes, words = w.codes()
        word_hash = hash_words(words)[codes]
        best: dict[tuple[int, int], tuple[float, int]] = {}

        def keep(row: int, n: int, start: int, s: float) -> None:
            if s >= self.threshold and (old := best.get((row, n)), old is None or (s, -start) > (old[0], -old[1]))[1]:
                best[row, n] = (s, start)

        for size, table in self.short.items():
            runs = run_hashes(word_hash, size)
            keys = np.asarray(list(table), np.uint64)
            for p in np.flatnonzero(np.isin(runs, keys)).tolist():
                row = int(np.searchsorted(w.first, p, "right")) - 1
                if p + size <= w.first[row + 1]:
                    for n in table[int(runs[p])]:
                        keep(row, n, p - int(w.first[row]), 1.0)
        shingles, at = shingle_hashes(word_hash, w.first, self.k)
        hit = np.flatnonzero(_among(shingles, self.known))
        for size, (items, known, index) in self.sizes.items() if len(hit) else ():
            own = hit[_among(shingles[hit], known)]
            for row, starts in self._starts(np.searchsorted(at, own, "right") - 1, own, at, size - self.k + 1):
                for i in range(0, len(starts), WINDOWS):
                    a, b = np.maximum(starts[i : i + WINDOWS], at[row]), np.minimum(starts[i : i + WINDOWS] + size - self.k + 1, at[row + 1])
                    lo = int(a[0])
                    prints, bags = window_fingerprints(shingles[lo : int(b.max())], a - lo, b - lo)
                    _, first = np.unique(bags, return_index=True)  # windows of the same shingles are one; the earliest counts
                    first.sort()
                    for q, n in zip(*(x.tolist() for x in index.near(prints[first]))):
                        x, y = int(a[first[q]]), int(b[first[q]])
                        keep(row, int(items[n]), x - int(at[row]), similarity(shingles[x:y], self.shingles(items[n])))
        for (row, n), (s, start) in sorted(best.items()):
            yield row, n, start, s

    def _starts(self, row: np.ndarray, place: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """Per row the starts of all windows of ``length`` shingles that hold enough of the places, in whatever order.

        A window of a shingles, c of them in an item of l, has at most
        similarity c / (a + l - c); only windows below the threshold by that
        bound are left out.  At a text's edge the window is what there is of it.
        """
        need = max(int(np.ceil(self.threshold * length - 1e-9)), 1)
        # places i .. i + need - 1 of one row that fit in a window; every window with enough holds such a run
        last = np.arange(len(row) - need + 1) + need - 1
        if not len(last):
            return
        runs = np.flatnonzero((row[last] == row[: len(last)]) & (place[last] - place[: len(last)] < length))
        for own in np.split(runs, np.flatnonzero(np.diff(row[runs])) + 1) if len(runs) else ():
            r = int(row[own[0]])
            # between the end of a run's window and the run's beginning; steps of runs overlap, so their union is taken
            a, b = place[last[own]] - length + 1, place[own] + 1
            a[1:] = np.maximum(a[1:], np.maximum.accumulate(b)[:-1])
            s = gather_runs(a[a < b], (b - a)[a < b])
            among = place[own[0] : last[own[-1]] + 1]
            c = np.searchsorted(among, s + length) - np.searchsorted(among, s)
            size = np.minimum(s + length, at[r + 1]) - np.maximum(s, at[r])
            s = s[c >= self.threshold * (size + length - c) - 1e-9]
            if len(s):
                yield r, s


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str | None]]]:
    """The benchmark in blocks of bounded size, in id order."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t")
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len((r["t"] or "").encode()) + 16
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


class Shared:
    """Broadcast blocks of a benchmark; a worker compiles each once and keeps as many as its bound allows."""

    def __init__(self, blocks: list, k: int, threshold: float, radius: int):
        self.key, self.blocks, self.settings = uuid.uuid4().hex, blocks, (k, threshold, radius)

    def __iter__(self) -> Iterator[Benchmark]:
        for n, block in enumerate(self.blocks):
            yield _compile((self.key, n), block, self.settings)


_compiled: dict[tuple, Benchmark] = {}


def _compile(key: tuple, block, settings: tuple) -> Benchmark:
    if key not in _compiled:
        if len(_compiled) >= max(1, COMPILED_BYTES // BLOCK_BYTES):
            del _compiled[next(iter(_compiled))]
        _compiled[key] = Benchmark(*block.value, *settings)
    return _compiled[key]


def scans(spark, benchmark: DataFrame, k: int, threshold: float, radius: int, id_col: str, text_col: str) -> Iterator[Shared]:
    """The benchmark for one scan of the documents, or for more where it is over SCAN_BYTES."""
    held: list = []
    for block in item_blocks(benchmark, id_col, text_col):
        held.append(spark.sparkContext.broadcast(block))
        if len(held) >= SCAN_BYTES // BLOCK_BYTES:
            yield Shared(held, k, threshold, radius)
            held = []
    if held:
        yield Shared(held, k, threshold, radius)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 23, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start_word, n_words, similarity) of each item that a document holds, at its best window.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  An item of fewer
    than k words has one shingle, its whole sequence, and is found where that
    stands.  Windows whose fingerprint differs from the item's in more than
    ``radius`` of 64 bits are not found.  Null and empty texts hold nothing, and
    items without words are in nothing; null ids stay; ids may be of any type;
    repeated documents and items give repeated rows; an empty table on either
    side gives no rows; other columns are ignored.  One scan of the documents
    for each SCAN_BYTES of items, without a shuffle.
    """
    kind, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {kind}, item {item_type.simpleString()}, start_word long, n_words long, similarity double"
    arrow_type = to_arrow_type(item_type)
    out = None
    for shared in scans(docs.sparkSession, benchmark, k, threshold, radius, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1)
                for i, j in text_blocks(texts):
                    for items in shared:
                        found = list(items.search(texts.slice(i, j - i)))
                        if found:
                            row, n, start, s = zip(*found)
                            columns = [b.column(0).take(pa.array([i + r for r in row])), pa.array([items.ids[x] for x in n], arrow_type), pa.array(start, pa.int64()), pa.array(items.size[list(n)], pa.int64()), pa.array(s, pa.float64())]
                            yield pa.RecordBatch.from_arrays(columns, ["id", "item", "start_word", "n_words", "similarity"])

        part = rows.mapInArrow(tidied(run), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def remove_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 23, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which ``find_leaks`` finds an item; one scan, no shuffle."""
    at = docs.columns.index(text_col)
    for shared in scans(docs.sparkSession, benchmark, k, threshold, radius, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(at).cast(pa.large_string())
                held = np.zeros(b.num_rows, bool)
                for i, j in text_blocks(texts):
                    for items in shared:
                        held[[i + found[0] for found in items.search(texts.slice(i, j - i))]] = True
                yield b.filter(pa.array(~held))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
