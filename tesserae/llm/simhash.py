"""SimHash near-duplicate groups, with pigeonring candidate filtering.

A 64-bit fingerprint is a ring of segments.  When two fingerprints differ in
at most r bits over m segments, some segment starts a chain whose first l
segments differ in at most floor(l * r / m) bits together, for every l from 1
to m.  Rows meet by their first segment (its budget at l = 1), and inside such
a bucket the second segment is looked up in a sorted array at its own budget,
so only pairs that already hold l = 1 and l = 2 are formed; l = 3 .. m prune
them before the whole distance is taken.

A bucket of very many rows is split before it is dealt: its rows meet by both
their first two segments, each at home under its own second segment and as a
visitor where one of that segment's unset bits is set, which is the budget of
one bit at l = 2.

Equal fingerprints meet once, in an aggregation, so any number of copies costs
one row.  A bucket emits a spanning forest of its links and not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import connected_components, forest
from tesserae.llm.shared import parallelism, stored
from tesserae.llm.textcore import gather_runs, text_blocks, tidied, words_of

SIGN = np.uint64(1 << 63)
#: Bytes of text fingerprinted at once; each byte of text takes some 30 of memory while it is.
FINGERPRINT_BLOCK = 2 << 20
#: Pairs formed at once within a bucket.
PAIR_BLOCK = 2_000_000
#: Rows of a first segment above which its bucket is split by the second.
BUCKET_ROWS = 200_000


def fingerprints(texts: pa.Array, k: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text's k-word shingles by XXH64: a bit is set if over half the hashes have it."""
    from itertools import repeat

    import xxhash

    w = words_of(texts)
    # one space before each word, none elsewhere: a shingle is then one slice
    lengths = w.ends - w.starts
    to = np.cumsum(lengths + 1) - lengths
    flat = np.full(int(lengths.sum() + len(lengths)), 32, np.uint8)
    flat[gather_runs(to, lengths)] = w.flat[gather_runs(w.starts, lengths)]
    data = flat.tobytes()
    counts = w.counts
    n_sh = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.append(0, np.cumsum(n_sh))
    begin = np.repeat(w.first[:-1], n_sh) + np.arange(at[-1]) - np.repeat(at[:-1], n_sh)
    last = begin + np.repeat(np.minimum(counts, k), n_sh) - 1
    starts, ends = to[begin], to[last] + lengths[last]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist())), repeat(seed)), np.uint64, len(starts))
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(n_sh)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        over = 2 * sums > n_sh[some, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def fingerprint_column(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) per row; null texts have no words and so fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fp = [fingerprints(texts.slice(i, j - i), k) for i, j in text_blocks(texts, FINGERPRINT_BLOCK)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(fp).view(np.int64) if fp else [], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidied(run), f"id {kind}, fp long")


class Ring:
    """Segment widths and chain budgets for radius r over m segments of 64 bits."""

    def __init__(self, radius: int, segments: int):
        if not 0 <= radius < segments:
            raise ValueError("a first segment must match exactly: radius < segments")
        self.r, self.m = radius, segments
        edges = np.linspace(0, 64, segments + 1).round().astype(int)
        self.low = edges[:-1].tolist()
        self.width = np.diff(edges).tolist()

    def budget(self, l: int) -> int:
        return l * self.r // self.m

    def segment(self, fp: np.ndarray, i: int) -> np.ndarray:
        i %= self.m
        return (fp >> np.uint64(self.low[i])) & np.uint64((1 << self.width[i]) - 1)

    def masks(self, i: int, bits: int) -> list[int]:
        i %= self.m
        return [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(self.width[i]), n)]


def bucket_links(ring: Ring, fp: np.ndarray, i: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within distance r among distinct fingerprints that agree in segment i."""
    none = np.empty(0, np.uint64)
    if len(fp) < 2:
        return none, none
    # the next segment, or as many as make long keys, in sorted order: the deeper key is used where runs are long
    second = ring.segment(fp, i + 1)
    order = np.argsort(second, kind="stable")
    fp, second = fp[order], second[order]
    us, vs = [], []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        x = fp[a] ^ fp[b]
        run = np.bitwise_count(ring.segment(x, i + 1)).astype(np.int64)
        ok = run <= ring.budget(2)
        for l in range(2, ring.m):
            run += np.bitwise_count(ring.segment(x, i + l))
            ok &= run <= ring.budget(l + 1)
        if ok.any():
            u, v = forest_of(fp[a[ok]], fp[b[ok]])
            us.append(u)
            vs.append(v)

    long: list[tuple[np.ndarray, np.ndarray]] = []
    for mask in ring.masks(i + 1, ring.budget(2)):
        key = second ^ np.uint64(mask)
        lo, hi = np.searchsorted(second, key, "left"), np.searchsorted(second, key, "right")
        at = np.arange(len(fp))
        lo = np.maximum(lo, at + 1)  # each pair once
        n = np.maximum(hi - lo, 0)
        deep = n > 512
        if deep.any():
            long.append((np.flatnonzero(deep), np.full(int(deep.sum()), mask, np.uint64)))
            n = np.where(deep, 0, n)
        sums = np.append(0, np.cumsum(n))
        p = 0
        while p < len(fp) and sums[p] < sums[-1]:
            q = max(p + 1, int(np.searchsorted(sums, sums[p] + PAIR_BLOCK, "right")) - 1)
            a = np.repeat(at[p:q], n[p:q])
            if len(a):
                take(a, lo[a] + np.arange(len(a)) - np.repeat(sums[p:q] - sums[p], n[p:q]))
            p = q
    if long:
        # many share both segments: look up the rest of the ring in one sorted array of whole fingerprints
        whole = np.argsort(fp, kind="stable")
        ordered = fp[whole]
        spread = 0
        rest = [l for l in range(2, ring.m)]
        for rows, masks in long:
            spread = int(np.bitwise_count(masks[0]))
            base = fp[rows] ^ (masks << np.uint64(ring.low[(i + 1) % ring.m]))
            for flips in _flips(ring, i, rest, spread):
                want = base ^ np.uint64(flips)
                j = np.searchsorted(ordered, want)
                hit = (j < len(ordered)) & (ordered[np.minimum(j, len(ordered) - 1)] == want)
                a, b = rows[hit], whole[j[hit]]
                keep = a != b
                if keep.any():
                    take(a[keep], b[keep])
    if not us:
        return none, none
    return forest_of(np.concatenate(us), np.concatenate(vs))


def _flips(ring: Ring, i: int, rest: list[int], spent: int) -> Iterator[int]:
    """Bit patterns over the remaining segments of the ring whose chains stay within budget."""
    if not rest:
        yield 0
        return
    l, tail = rest[0], rest[1:]
    s = (i + l) % ring.m
    for n in range(ring.budget(l + 1) - spent + 1):
        for c in combinations(range(ring.low[s], ring.low[s] + ring.width[s]), n):
            for more in _flips(ring, i, tail, spent + n):
                yield sum(1 << b for b in c) | more


def forest_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = forest((u ^ SIGN).view(np.int64), (v ^ SIGN).view(np.int64))
    return a.view(np.uint64) ^ SIGN, b.view(np.uint64) ^ SIGN


def near_links(distinct: DataFrame, radius: int, segments: int, bucket_rows: int | None = None) -> DataFrame:
    """(u, v) links that connect whatever pairs of distinct ``fp`` within ``radius`` connect."""
    ring = Ring(radius, segments)
    spark = distinct.sparkSession
    segment = lambda i: F.shiftrightunsigned("fp", ring.low[i % segments]).bitwiseAND(F.lit((1 << ring.width[i % segments]) - 1))
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), segment(i).alias("s"), segment(i + 1).alias("next")) for i in range(segments)])).alias("k")).select("k.*", "fp")
    if ring.budget(2) <= 1 and max(ring.width) <= 20:
        # at most segments * 2 ** width rows, whatever the corpus
        limit = BUCKET_ROWS if bucket_rows is None else bucket_rows
        large = keyed.groupBy("i", "s").count().where(F.col("count") > limit).select("i", "s", F.lit(True).alias("large"))
        keyed = keyed.join(F.broadcast(stored(large, "simhash-large")), ["i", "s"], "left")
        visits = [F.when((F.shiftright("next", b) % 2 == 0) & (F.lit(b) < F.element_at(F.lit(ring.width), (F.col("i") + 1) % segments + 1)), F.col("next") + (1 << b)) for b in range(max(ring.width))] if ring.budget(2) else []
        homes = F.when(F.col("large"), F.array_compact(F.array(F.col("next"), *visits))).otherwise(F.array(F.lit(-1).cast("long")))
        keyed = keyed.withColumn("home", F.explode(homes))
    else:
        keyed = keyed.withColumn("home", F.lit(-1).cast("long"))
    # a count that adaptive execution keeps: the work is in the tasks, not in the bytes
    keyed = keyed.select("i", F.struct("s", "home").alias("s"), "fp").repartition(parallelism(spark), "i", "s").sortWithinPartitions("i", "s", "fp").select("i", F.xxhash64("s").alias("s"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(i: int, fp: list[np.ndarray]) -> pa.RecordBatch | None:
            u, v = bucket_links(ring, np.concatenate(fp).view(np.uint64), i)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]) if len(u) else None

        held: list[np.ndarray] = []
        now = None
        for b in batches:
            i, s, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cut = np.flatnonzero((np.diff(i) != 0) | (np.diff(s) != 0)) + 1
            for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, len(i)).tolist()):
                if hi == lo:
                    continue
                key = (int(i[lo]), int(s[lo]))
                if key != now and held:
                    if (out := links(now[0], held)) is not None:
                        yield out
                    held = []
                now = key
                held.append(fp[lo:hi])
        if held and (out := links(now[0], held)) is not None:
            yield out

    return keyed.mapInArrow(tidied(run), "u long, v long")


def simhash_groups(docs: DataFrame, k: int = 3, radius: int = 3, segments: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``radius``
    bits; component_id is the smallest id reachable.  Null and empty texts have
    fingerprint zero and are linked like any other; a null id stays null and is
    never a component's id unless all its ids are null; repeated rows give
    repeated rows; an empty table gives none; other columns are ignored.
    """
    fps = stored(fingerprint_column(docs, k, id_col, text_col), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    distinct = stored(distinct, "simhash-distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius, segments), "simhash-links")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.join(named, "root").select(F.col("fp").alias("f"), "component_id"), "simhash-classes")
    return fps.join(classes, fps.fp == classes.f).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, k: int = 3, radius: int = 3, segments: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of ``simhash_groups``, the one of the smallest id.

    Rows that repeat an id are one document and stay or go together; rows with
    a null id all stay.
    """
    groups = simhash_groups(docs, k, radius, segments, id_col, text_col)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
