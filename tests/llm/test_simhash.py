import random

import numpy as np
import pytest
import xxhash

from tesserae.llm.components import forest
from tesserae.llm.simhash import Ring, bucket_links, fingerprints, near_links, one_of_each_group, simhash_groups
from tests.llm.data import SF, awkward, empty, words


def brute_fingerprint(text, k=3):
    w = words(text)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(prints)
    got = simhash_groups(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = {r["doc_id"] for r in one_of_each_group(docs).collect()}
    assert kept == set(want.values())


def planted(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = r.getrandbits(64)
        out.append(base)
        for _ in range(r.randrange(4)):
            x = base
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    return np.unique(np.asarray(out, np.uint64))


@pytest.mark.parametrize("radius,segments", [(3, 4), (5, 6), (2, 3)])
def test_pigeonring_loses_no_link(radius, segments):
    fp = planted(150, radius)
    ring = Ring(radius, segments)
    links = set()
    for i in range(segments):
        s = ring.segment(fp, i)
        for v in np.unique(s):
            u, w = bucket_links(ring, fp[s == v], i)
            links |= {frozenset((int(a), int(b))) for a, b in zip(u, w)}
    a = np.asarray([min(x) for x in links], np.uint64)
    b = np.asarray([max(x) for x in links], np.uint64)
    node, root = forest(a.view(np.int64), b.view(np.int64))
    got = dict(zip(node.tolist(), root.tolist()))
    want_u, want_v = [], []
    for i in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius)
        want_u += [fp[i]] * len(near)
        want_v += fp[near].tolist()
    wn, wr = forest(np.asarray(want_u, np.uint64).view(np.int64), np.asarray(want_v, np.uint64).view(np.int64))
    assert got == dict(zip(wn.tolist(), wr.tolist()))


@pytest.mark.parametrize("radius,segments", [(3, 4), (2, 4), (1, 2)])
def test_split_buckets_lose_no_link(spark, radius, segments):
    # all alike in one segment, so that its bucket is large
    r = np.random.default_rng(radius)
    fp = planted(200, 7 + radius) & ~np.uint64(0xFFFF) | np.uint64(77)
    fp = np.unique(np.concatenate([fp, fp ^ (np.uint64(1) << r.integers(0, 64, len(fp)).astype(np.uint64))]))
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")

    def classes(rows):
        node, root = forest(np.asarray([x["u"] for x in rows]), np.asarray([x["v"] for x in rows]))
        return dict(zip(node.tolist(), root.tolist()))

    want = classes([{"u": int(fp[i].view(np.int64)), "v": int(x)} for i in range(len(fp)) for x in fp[np.bitwise_count(fp ^ fp[i]) <= radius].view(np.int64)])
    for rows in (5, 10**9):
        assert classes(near_links(table, radius, segments, rows).collect()) == want


def test_dense_bucket_uses_the_deep_key():
    # 2000 fingerprints alike in two segments: the rest of the ring is looked up, not compared pair by pair
    r = np.random.default_rng(1)
    fp = np.unique((r.integers(0, 1 << 32, 2000).astype(np.uint64) << np.uint64(32)) | np.uint64(0x12345678))
    extra = fp[:200] ^ (np.uint64(1) << np.uint64(40))
    fp = np.unique(np.concatenate([fp, extra]))
    u, v = bucket_links(Ring(3, 4), fp, 0)
    near = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3) if i < j]
    node, root = forest(fp[[i for i, _ in near]].view(np.int64), fp[[j for _, j in near]].view(np.int64))
    gn, gr = forest(u.view(np.int64), v.view(np.int64))
    assert dict(zip(node.tolist(), root.tolist())) == dict(zip(gn.tolist(), gr.tolist()))


def test_edges(spark):
    got = simhash_groups(awkward(spark)).collect()
    assert len(got) == awkward(spark).count()
    none = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(none) >= 4 and {r["component_id"] for r in none} == {0}
    assert simhash_groups(empty(spark)).count() == 0
    import pyarrow as pa

    assert fingerprints(pa.array([], pa.string())).tolist() == []
