import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import decontaminate
from tesserae.llm.decontaminate import Benchmark, HammingIndex, find_leaks, fingerprint, remove_leaks, similarity
from tesserae.llm.substrings import chains, grow, lcs, repeated_passages, winnowed
from tests.llm.data import SF, awkward, empty, invented, words


def fuzzed(passage, rate, seed):
    r = random.Random(seed)
    out = []
    for w in passage:
        x = r.random()
        if x < rate / 3:
            continue
        out.append(f"z{r.randrange(10**6)}" if x < 2 * rate / 3 else w)
        if 2 * rate / 3 <= x < rate:
            out.append(f"z{r.randrange(10**6)}")
    return out


def test_planted_passages(spark):
    p, q = invented(70, 1), invented(120, 2)
    rows = [(i, invented(200, 100 + i)) for i in range(30)]
    rows += [(i, invented(50, 100 + i) + p + invented(90, 200 + i)) for i in range(30, 45)]
    rows += [(i, invented(50, 100 + i) + (q if i == 45 else fuzzed(q, 0.05, i)) + invented(90, 200 + i)) for i in range(45, 55)]
    rows += [(i, rows[31][1]) for i in range(55, 60)]
    rows += [(60, p[:49]), (61, p[:50])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = repeated_passages(docs).collect()
    assert all(r["source_doc_id"] < r["doc_id"] for r in got)
    found = {r["doc_id"] for r in got if not r["whole_copy"]}
    assert found == {*range(31, 45), *range(46, 55), 61}
    assert {(r["doc_id"], r["source_doc_id"]) for r in got if r["whole_copy"]} == {(i, 31) for i in range(55, 60)}
    exact = [r for r in got if r["doc_id"] in range(31, 45)]
    assert all((r["start_word"], r["end_word"], r["similarity"]) == (50, 120, 1.0) for r in exact)


def test_no_exact_repeat_is_missed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, want = {}, set()
    for r in sorted(docs.collect()):
        w = words(r["text"])
        for a in range(len(w) - 49):
            if seen.setdefault(tuple(w[a : a + 50]), r["doc_id"]) != r["doc_id"]:
                want.add(r["doc_id"])
    assert want <= {r["doc_id"] for r in repeated_passages(docs).collect()}


def reported(spark, rows):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    return repeated_passages(docs).collect()


def test_partial_holders_hide_no_passage(spark):
    p = invented(60, 400)
    part = {1: p[:22], 2: p[19:41], 3: p[38:], 12: p[:22], 13: p[19:41], 14: p[38:]}
    rows = [(i, invented(40, 410 + i) + w + invented(40, 430 + i)) for i, w in part.items()]
    rows += [(i, invented(40, 450 + i) + p + invented(40, 480 + i)) for i in (10, 20)]
    (got,) = reported(spark, rows)
    assert (got["doc_id"], got["start_word"], got["end_word"], got["source_doc_id"], got["source_start"], got["source_end"], got["similarity"]) == (20, 40, 100, 10, 40, 100, 1.0)


def test_partial_holders_hide_no_fuzzy_passage(spark):
    p = invented(60, 700)
    q = [f"q{n}" if n in (15, 30, 45) else w for n, w in enumerate(p)]
    cuts = ((0, 25), (18, 44), (37, 60))
    part = {n + 1: p[a:b] for n, (a, b) in enumerate(cuts)} | {n + 12: q[a:b] for n, (a, b) in enumerate(cuts)}
    rows = [(i, invented(40, 710 + i) + w + invented(40, 730 + i)) for i, w in part.items()]
    rows += [(i, invented(40, 750 + i) + w + invented(40, 780 + i)) for i, w in ((10, p), (20, q))]
    (got,) = reported(spark, rows)
    assert (got["doc_id"], got["start_word"], got["end_word"], got["source_doc_id"], got["source_start"], got["source_end"]) == (20, 40, 100, 10, 40, 100)
    assert got["similarity"] == pytest.approx(57 / 60)


def test_exact_runs_among_partial_holders(spark):
    r = random.Random(500)
    passages = [invented(r.randrange(50, 110), 510 + n, 100_000) for n in range(12)]
    rows = []
    for i in range(260):
        w = invented(r.randrange(20, 60), 600 + i, 100_000)
        for _ in range(r.randrange(1, 4)):
            p = r.choice(passages)
            n = r.choice([r.randrange(15, 50), r.randrange(30, 50), 50, r.randrange(50, len(p) + 1)])
            a = r.randrange(0, len(p) - min(n, len(p)) + 1)
            w += p[a : a + n] + invented(r.randrange(5, 30), 10_000 + 10 * i + len(w), 100_000)
        rows.append((i, w))
    seen, want = {}, {}
    for i, w in rows:
        for a in range(len(w) - 49):
            if seen.setdefault(tuple(w[a : a + 50]), i) != i:
                want.setdefault(i, set()).add(a)
    by_doc = {}
    for x in reported(spark, rows):
        by_doc.setdefault(x["doc_id"], []).append((x["start_word"], x["end_word"]))
        a, b = dict(rows)[x["doc_id"]][x["start_word"] : x["end_word"]], dict(rows)[x["source_doc_id"]][x["source_start"] : x["source_end"]]
        assert x["source_doc_id"] < x["doc_id"] and min(len(a), len(b)) >= 50
        assert lcs(a, b) / max(len(a), len(b)) == pytest.approx(x["similarity"]) and x["similarity"] >= 0.8
    assert set(want) <= set(by_doc) and len(want) > 60
    # every such run meets a passage in its words
    assert all(any(s < a + 50 and a < e for s, e in by_doc[i]) for i, starts in want.items() for a in starts)


def test_fuzzy_passages(spark):
    for rate, least in ((0.1, 0.95), (0.15, 0.8)):
        rows = []
        for n in range(100):
            p = invented(60, 2000 + n)
            rows += [(2 * n, invented(80, 2200 + n) + p + invented(80, 2400 + n)), (2 * n + 1, invented(80, 2600 + n) + fuzzed(p, rate, n) + invented(80, 2800 + n))]
        got = {x["doc_id"] for x in reported(spark, rows)}
        reached = {2 * n + 1 for n in range(100) if lcs(invented(60, 2000 + n), fuzzed(invented(60, 2000 + n), rate, n)) / max(60, len(fuzzed(invented(60, 2000 + n), rate, n))) >= 0.82}
        assert got <= set(range(1, 200, 2)) and len(got & reached) >= least * len(reached), (rate, len(got & reached), len(reached))


def test_an_inserted_word_at_an_edge_is_crossed():
    a = list(range(40))
    assert grow(a, [99, *a]) == (40, 41) and grow([99, 98, *a], a) == (42, 40) and grow(a, a[:10] + [77] + a[11:]) == (40, 40)
    assert grow(a, list(range(100, 140))) == (0, 0) and grow([], a) == (0, 0)


def test_chaining_against_a_quadratic_program():
    r = random.Random(4)
    points = sorted({(r.randrange(60), r.randrange(60)) for _ in range(40)}, key=lambda p: (p[1], p[0]))
    x, y = (np.asarray(c) for c in zip(*points))
    k, g = 6, 0.3
    f = []
    for i in range(len(x)):
        before = [f[j] - g * (x[i] - x[j] + y[i] - y[j] - 2 * k) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
        f.append(k + max([0, *before]))
    best = chains(x, y, k, g)[0]
    got = k * len(best) - g * sum(x[b] - x[a] + y[b] - y[a] - 2 * k for a, b in zip(best, best[1:]))
    assert got == pytest.approx(max(f))


def test_lcs_and_winnowing():
    r = random.Random(5)
    a, b = ([r.randrange(6) for _ in range(40)] for _ in range(2))
    table = np.zeros((41, 41), int)
    for i in range(40):
        for j in range(40):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert lcs(a, b) == table[-1, -1] and lcs([], b) == 0
    h = np.random.default_rng(6).integers(0, 1 << 60, 300).astype(np.uint64)
    pick = set(winnowed(h, np.asarray([0, 100, 100, 300]), 12).tolist())
    for lo, hi in ((0, 100), (100, 300)):
        for s in range(lo, hi - 11):
            assert s + int(h[s : s + 12].argmin()) in pick


def best_windows(docs, items):
    """The best similarity of each item's windows in each document, by trying all of them."""
    def shingles(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    out = {}
    for i, text in docs:
        w = words(text)
        for n, item in items:
            want, m, best = shingles(words(item)), len(words(item)), 0.0
            if not set(shingles(w)) & set(want):
                continue
            for a in range(-m + 5, max(1, len(w) - 4)):
                own = w[max(0, a) : max(0, a + m)]
                if own:
                    s = shingles(own)
                    best = max(best, sum((s & want).values()) / sum((s | want).values()))
            if best >= 0.8:
                out[i, n] = round(best, 9)
    return out


def test_leaks_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    want = best_windows([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in find_leaks(docs, bench).collect()}
    assert want and got == want
    clean = {r["doc_id"] for r in docs.collect()} - {i for i, _ in want}
    assert {r["doc_id"] for r in remove_leaks(docs, bench).collect()} == clean


def test_altered_leaks_and_short_items(spark):
    item = invented(60, 7)
    changed = item[:30] + ["other"] + item[31:]
    shifted = item[:20] + ["extra"] + item[20:]
    half = item[:30] + invented(30, 8)
    rows = [invented(80, 9 + n) + x + invented(80, 30 + n) for n, x in enumerate((item, changed, shifted, half))] + [invented(20, 70) + ["a1", "b1"] + invented(9, 71), ["a1", "c", "b1"]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "A1 b1"), (3, ""), (4, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()}
    assert got == set(best_windows(list(enumerate(map(" ".join, rows))), [(1, " ".join(item))])) | {(4, 2)}
    assert {(0, 1), (1, 1), (2, 1)} <= got and (3, 1) not in got


def test_reordered_items_are_found(spark):
    item = invented(100, 50)
    thirds = item[66:] + item[:33] + item[33:66]
    moved = item[20:] + item[:20]
    shuffled = [w for p in range(90, -1, -10) for w in item[p : p + 10]]
    rows = [invented(80, 60 + n) + x + invented(80, 70 + n) for n, x in enumerate((item[50:] + item[:50], moved, thirds, shuffled, item[50:] + item[:40]))]
    rows += [item[50:] + item[:45], item[50:] + item[:50] + item]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    want = best_windows(list(enumerate(map(" ".join, rows))), [(1, " ".join(item))])
    assert {(0, 1), (1, 1), (2, 1), (6, 1)} <= set(want) and (3, 1) not in want
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in find_leaks(docs, bench).collect()} == want


def test_block_index_finds_all_within_the_radius():
    b = Benchmark(list(range(50)), [" ".join(invented(30, i)) for i in range(50)], 5, 0.8, 19)
    r = random.Random(9)
    for n in range(50):
        fp = int(b.print[n])
        for flip in r.sample(range(64), 19):
            fp ^= 1 << flip
        assert n in b.within(fp)
        assert b.within(fp) == {m for m in range(50) if (int(b.print[m]) ^ fp).bit_count() <= 19}
    a = np.asarray([1, 1, 2, 3], np.uint64)
    assert similarity(a, np.asarray([1, 2, 2], np.uint64)) == 2 / 5
    assert fingerprint(np.asarray([5], np.uint64)) == 5


def test_index_at_any_size_and_radius():
    r = np.random.default_rng(3)
    for n, radius in ((1, 19), (200, 23), (3000, 7), (30_000, 11)):
        prints = r.integers(0, 1 << 63, n).astype(np.uint64)
        asked = np.concatenate([prints[:40], prints[:40] ^ np.uint64(0b1011), r.integers(0, 1 << 63, 40).astype(np.uint64)])
        q, v = np.nonzero(np.bitwise_count(asked[:, None] ^ prints) <= radius)
        got = HammingIndex(prints, radius).near(asked)
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(q.tolist(), v.tolist()))
    assert HammingIndex(np.empty(0, np.uint64), 19).near(np.zeros(3, np.uint64))[0].size == 0


def test_candidates_come_from_the_index(monkeypatch):
    item = invented(40, 90)
    text = pa.array([" ".join(invented(30, 91) + item + invented(30, 92))])
    found = list(Benchmark([7], [" ".join(item)], 5, 0.8, 23).search(text))
    assert found == [(0, 0, 30, 1.0)]
    monkeypatch.setattr(HammingIndex, "near", lambda self, prints: (np.empty(0, np.int64),) * 2)
    assert list(Benchmark([7], [" ".join(item)], 5, 0.8, 23).search(text)) == []


def test_many_items_in_one_scan(spark, monkeypatch):
    r = random.Random(93)
    items = [invented(r.randrange(15, 60), 10_000 + n, 3000) for n in range(10_000)]
    rows = [invented(60, 94 + n) + items[n * 97 % 10_000] + invented(60, 300 + n) for n in range(100)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"item {n}", " ".join(w)) for n, w in enumerate(items)], "item_id string, text string")
    want = {(n, f"item {n * 97 % 10_000}") for n in range(100)}
    for block in (8 << 20, 1 << 20):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = find_leaks(docs, bench)
        assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want
        assert "Union" not in got._jdf.queryExecution().toString()
    assert remove_leaks(docs.union(docs.limit(0)), bench).count() == 0


def test_leaks_at_the_threshold_and_repetitive_texts():
    r = random.Random(95)
    items = [invented(n, 1000 + n, 500) for n in (15, 22, 38, 59)] + [["x"] * 30, ["a", "b"] * 12, invented(38, 999, 500)]
    rows = [["x"] * 300, ["a", "b"] * 100 + ["x"] * 28, items[3] + items[3], items[2][4:], items[2][:20] + ["q"] + items[2][21:]]
    for n in range(60):
        w = list(r.choice(items))
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = "z"
        rows.append(invented(20, n) + w + invented(20, 50 + n))
    b = Benchmark(list(range(len(items))), [" ".join(w) for w in items], 5, 0.8, 23)
    got = {(row, n): round(s, 9) for row, n, _, s in b.search(pa.array([" ".join(w) for w in rows]))}
    assert got == best_windows([(i, " ".join(w)) for i, w in enumerate(rows)], [(n, " ".join(w)) for n, w in enumerate(items)])


def test_edges(spark):
    docs, bench = awkward(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert repeated_passages(docs).where("doc_id is null").count() == 0
    assert find_leaks(docs, bench).count() == 0
    assert remove_leaks(docs, bench).count() == docs.count()
    assert remove_leaks(docs, bench).columns == docs.columns
    assert repeated_passages(empty(spark)).count() == find_leaks(empty(spark), bench).count() == 0
    assert find_leaks(docs, bench.limit(0)).count() == 0
