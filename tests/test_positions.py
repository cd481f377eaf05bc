"""Phrase and span windows: published cases, brute force, and columns against lists."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators.positions import near, near_ordered, near_unordered, sloppy_freq, sloppy_frequency

ALL, APART = "A A A", "A 1 2 3 A 4 5 6 A"
TEXTS = {"one": f"X {ALL} Y", "two": f"X {APART} Y", "three": f"X {ALL} A Y", "mixed": "A A X A X B A X B B A A X B A A"}
TEXTS |= {k + " twice": f"{v} N N N N {v.replace('X ', '', 1)}" for k, v in list(TEXTS.items())[:3]}


def frequency(text, phrase, slop):
    words, terms = text.split(), phrase.split()
    lists = [[i for i, w in enumerate(words) if w == t] for t in terms]
    return sloppy_frequency(lists, range(len(terms)), slop, [terms.index(t) for t in terms])


@pytest.mark.parametrize("text,phrase,least", [("one", ALL, 0), ("two", ALL, 6), ("two", APART, 0), ("three", ALL, 0), ("mixed", "X A A", 1)])
def test_published_cases_of_repeated_terms(text, phrase, least):
    for slop in range(1, 30):
        f = frequency(TEXTS[text], phrase, slop)
        assert (f > 0) == (slop >= least), slop
        if slop >= least and text != "mixed":
            assert frequency(TEXTS[text + " twice"], phrase, slop) > f


def spans(r, n=7, reach=24):
    return sorted((p, p + 1 + r.randrange(2)) for p in r.sample(range(reach), r.randrange(n)))


def test_ordered_windows_are_the_minimal_ones():
    r = random.Random(1)
    for _ in range(300):
        lists = [spans(r) for _ in range(3)]
        chains = [c for c in itertools.product(*lists) if c[0] < c[1] < c[2]]
        # every end has its latest chain; every start its earliest end
        latest = {}
        for c in sorted(chains, key=lambda c: c[::-1]):
            latest[c[2]] = c
        best = {}
        for c in sorted(latest.values(), key=lambda c: c[2]):
            best.setdefault(c[0][0], c)
        want = [(c[0][0], c[2][1]) for c in sorted(best.values(), key=lambda c: c[2]) if sum(max(0, b[0] - a[1]) for a, b in zip(c, c[1:])) <= 4]
        assert near_ordered(lists, 4) == want


def test_columns_equal_lists(spark):
    r = random.Random(2)
    rows = [(i, *[sorted(r.sample(range(25), r.randrange(7))) for _ in range(3)]) for i in range(400)]
    docs = spark.createDataFrame(rows, "i int, a array<int>, b array<int>, c array<int>")
    span = lambda x: F.transform(x, lambda p: F.struct(p.alias("s"), (p + 1 + p % 2).alias("e")))
    slots = [F.col(x) for x in "abc"]
    one, two, three = frozenset("a"), frozenset("b"), frozenset("c")
    got = docs.select(
        "i",
        near(3, True)(*map(span, slots)).alias("ordered"),
        near(3, False)(*map(span, slots)).alias("unordered"),
        sloppy_freq(slots, (0, 1, 2), 4, [one, two, three]).alias("sloppy"),
        sloppy_freq([slots[0], slots[1], slots[0]], (0, 1, 3), 5, [one, two, one]).alias("repeated"),
    )
    for x in got.collect():
        lists = [[(p, p + 1 + p % 2) for p in own] for own in rows[x["i"]][1:]]
        a, b, c = rows[x["i"]][1:]
        assert [tuple(s) for s in x["ordered"]] == near_ordered(lists, 3)
        assert [tuple(s) for s in x["unordered"]] == near_unordered(lists, 3)
        assert x["sloppy"] == pytest.approx(sloppy_frequency([a, b, c], (0, 1, 2), 4, [0, 1, 2]))
        assert x["repeated"] == pytest.approx(sloppy_frequency([a, b, a], (0, 1, 3), 5, [0, 1, 0]))


def test_outside_is_one_fold(spark):
    from tesserae.functions import analysis as an
    from tesserae.operators import positions as P
    from tesserae.plans import ast as A
    from tesserae.plans.search import ScanView, Searcher
    from tesserae.schema import FieldSpec, Schema

    r = random.Random(3)

    def spans(n):
        return sorted((a, a + r.randint(0, 6)) for a in (r.randint(0, 60) for _ in range(n)))

    rows = [(i, spans(r.randint(0, 150 if i % 9 == 0 else 12)), spans(r.randint(0, 8))) for i in range(60)]
    df = spark.createDataFrame(rows, f"id int, a {P.SPANS}, b {P.SPANS}")
    got = {x["id"]: [tuple(y) for y in x["o"]] for x in df.select("id", P.outside(F.col("a"), F.col("b")).alias("o")).collect()}
    assert got == {i: [p for p in a if not any(p[0] < e and s < p[1] for s, e in b)] for i, a, b in rows}

    docs = spark.createDataFrame([(0, "of the " * 900 + "the"), (1, "of the")], "doc_id long, f string")
    of, the = A.SpanTerm("f", "of"), A.SpanTerm("f", "the")
    hits = Searcher(ScanView(docs, Schema("doc_id", {"f": FieldSpec("f", an.WHITESPACE)}))).hits(A.SpanNot(the, A.SpanNear((of, the), 0, True)))
    assert [x["doc_id"] for x in hits.collect()] == [0]
    # the excluded spans were found anew for each included one
    assert "exists(" not in hits._jdf.queryExecution().optimizedPlan().toString()
