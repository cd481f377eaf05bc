"""Maintenance of a written index, numeric fields, highlighting by analyzers, filter caches, query algebra."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tesserae.functions import analysis as an
from tesserae.functions.codecs import covering, sortable_long, trie_range
from tesserae.operators import highlight as H
from tesserae.operators.filters import FilterCache, TimeExceeded, within_time
from tesserae.plans import ast as A
from tesserae.plans.search import ScanView, Searcher
from tesserae.schema import FieldSpec, Schema, numeric_field
from tesserae.sources.index import IndexReader, IndexWriter, Lock, LockTaken, MultiIndexView, unlock
from tesserae.streaming.prospective import match_stored

SCHEMA = Schema("id", {"f": FieldSpec("f", an.WHITESPACE, payload=lambda t: F.length(t["term"])), "n": numeric_field("n")})


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, f string, n long")


ROWS = [(i, f"w{i % 3} x{i % 5} all all y{i}", (i - 20) * 7) for i in range(40)]


@pytest.fixture()
def writer(spark, tmp_path):
    return IndexWriter(spark, f"file://{tmp_path}/index", SCHEMA, create=True, keep=5)


def ids(view, q):
    return sorted(r["id"] for r in Searcher(view).hits(q).collect())


def test_scores_of_index_and_scan_agree(spark, writer):
    docs = table(spark, ROWS)
    writer.add(docs.where("id < 15"))
    writer.add(docs.where("id >= 15"))
    scan, index = Searcher(ScanView(docs, SCHEMA)), Searcher(writer.reader())
    for q in (A.Term("f", "all"), A.any_of(A.Term("f", "w1"), A.Prefix("f", "x", "scoring")), A.phrase("f", "all", "all"), A.Payload(A.SpanTerm("f", "all"), "max"), A.NumericRange("n", -30, 60), A.NumericRange("n", None, 0, include_high=False), A.Prefix("f", "y1", "auto"), A.Wildcard("f", "?1", "filter")):
        want = sorted(map(tuple, scan.hits(q).collect()))
        assert want and sorted(map(tuple, index.hits(q).collect())) == want, str(q)
    assert ids(writer.reader(), A.NumericRange("n", -30, 60)) == [i for i, _, n in ROWS if -30 <= n <= 60]
    assert sorted(map(tuple, writer.reader().postings("f").collect())) == sorted(map(tuple, ScanView(docs, SCHEMA).postings("f").collect()))


def test_merging_deletes_and_norms(spark, writer):
    docs = table(spark, ROWS)
    for k in range(4):
        writer.add(docs.where(f"id % 4 = {k}"))
    assert writer.reader().num_docs() == writer.reader().max_doc() == 40
    writer.delete_query(A.NumericRange("n", None, -70, include_high=False))
    assert (writer.reader().num_docs(), writer.reader().max_doc()) == (30, 40)
    writer.undelete_all()
    assert writer.reader().num_docs() == 40
    writer.delete_terms("f", "w0")
    live = [i for i in range(40) if i % 3]
    writer.optimize(2)
    assert len(writer.now.segments) == 2 and ids(writer.reader(), A.MatchAll()) == live
    writer.expunge_deletes()
    assert not writer.now.deletes and ids(writer.reader(), A.MatchAll()) == live and writer.reader().max_doc() == len(live)
    before = {r["id"]: r["score"] for r in Searcher(writer.reader()).hits(A.Term("f", "all")).collect()}
    writer.set_norm(spark.createDataFrame([(1,), (2,)], "id long"), "f", 2.0)
    after = {r["id"]: r["score"] for r in Searcher(writer.reader()).hits(A.Term("f", "all")).collect()}
    norm = 0.4375  # of five tokens
    assert {i: s for i, s in after.items() if i > 2} == {i: s for i, s in before.items() if i > 2}
    assert after[1] == pytest.approx(before[1] * 2.0 / norm, rel=1e-5) and after[2] > before[2]
    writer.optimize()
    assert len(writer.now.segments) == 1 and ids(writer.reader(), A.MatchAll()) == live


def test_levels_merge_by_themselves(spark, tmp_path):
    w = IndexWriter(spark, f"file://{tmp_path}/i", SCHEMA, create=True, merge_factor=3, merge_least=4)
    docs = table(spark, ROWS)
    for k in range(5):
        w.add(docs.where(f"id div 4 = {k}"))
        w.commit()
    assert len(w.now.segments) == 3 and ids(w.reader(), A.MatchAll()) == list(range(20))
    assert sorted(w.now.sizes.values()) == [4, 4, 12]


def test_two_phases_and_locks(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    w = IndexWriter(spark, path, SCHEMA, create=True, lock=True)
    with pytest.raises(LockTaken):
        IndexWriter(spark, path, SCHEMA, lock=True)
    w.add(table(spark, ROWS[:5]))
    w.prepare({"by": "test"})
    with pytest.raises(FileNotFoundError):
        IndexReader.open(spark, path, SCHEMA)
    w.commit()
    assert IndexReader.open(spark, path, SCHEMA).commit.user_data == {"by": "test"}
    w.add(table(spark, ROWS[5:9]))
    w.prepare()
    w.rollback()
    assert w.reader().num_docs() == 5
    w.close()
    with Lock(w.files, wait=0) as lock:
        assert lock.is_locked()
    IndexWriter(spark, path, SCHEMA, lock=True)
    unlock(spark, path)
    IndexWriter(spark, path, SCHEMA, lock=True).close()


def test_several_indexes_score_as_one(spark, tmp_path):
    docs = table(spark, ROWS)
    parts = []
    for k in range(2):
        w = IndexWriter(spark, f"file://{tmp_path}/{k}", SCHEMA, create=True)
        w.add(docs.where(f"id % 2 = {k}"))
        parts.append(w.reader())
    q = A.any_of(A.Term("f", "w1"), A.Fuzzy("f", "x1", 0.4))
    assert sorted(map(tuple, Searcher(MultiIndexView(parts)).hits(q).collect())) == sorted(map(tuple, Searcher(ScanView(docs, SCHEMA)).hits(q).collect()))


def test_trie_ranges():
    r = random.Random(1)
    for _ in range(200):
        a, b = sorted(r.randrange(1 << 12) for _ in range(2))
        got = [x for s, lo, hi in covering(a, b, 3, 12) for x in range(lo << s, (hi + 1) << s)]
        assert sorted(got) == list(range(a, b + 1))
    assert covering(3, 2) == [] and trie_range(5, 4) == []
    assert len(trie_range(-(10**17), 10**18)) <= 2 * 15 + 1


def test_sortable_longs(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 1e-310, 5e-324, -5e-324, 1.5e308, -1.5e308, 2.0, 3.0, 2.0**-1022, math.pi, float("inf"), float("-inf")]
    values += [random.Random(k).uniform(-1, 1) * 10.0 ** random.Random(k).randrange(-300, 300) for k in range(300)]

    def want(x):
        (b,) = struct.unpack(">q", struct.pack(">d", x))
        return b ^ ((1 << 63) - 1) if b < 0 else b

    for x in spark.createDataFrame([(v,) for v in values], "x double").select("x", sortable_long(F.col("x")).alias("s")).collect():
        assert x["s"] == want(x["x"]), x["x"]


def test_filters_lists_and_queries(spark, tmp_path):
    terms = lambda s, t: [x["term"] for x in spark.createDataFrame([(t,)], "t string").select(s(F.col("t"))).first()[0]]
    assert terms(an.Analyzer(an.whitespace, (an.latin1_folding,)), "Ævar çà ĉu straße") == ["AEvar", "ca", "ĉu", "strasse"]
    assert terms(lambda c: an.tee(an.whitespace(c), lambda t: F.startswith(t["term"], F.lit("a")))[1], "ab cd ae") == ["ab", "ae"]
    assert an.word_list([" one ", "", "# no", "two"], "#") == ["one", "two"] and an.stem_dictionary(["a\tb", "c"]) == {"a": "b"}
    (tmp_path / "words").write_text("one\n two\n")
    assert an.read_words(spark, f"file://{tmp_path}/words") == ["one", "two"]
    a, b, c = (A.Term("f", x) for x in "abc")
    assert A.combined([A.any_of(a, b, disable_coord=True), b, c]) == A.any_of(a, b, c, disable_coord=True)
    assert A.combined([a, a]) == a
    assert A.merged([A.any_of(a, b), A.all_of(b), A.any_of(b)]).clauses == (A.Clause(A.SHOULD, a), A.Clause(A.SHOULD, b), A.Clause(A.MUST, b))


def test_cached_filters_and_time(spark, tmp_path):
    docs = table(spark, ROWS)
    view = ScanView(docs, SCHEMA)
    cache = FilterCache(view, f"file://{tmp_path}/filters", most=2)
    s = Searcher(view)
    for _ in range(2):
        got = s.hits(A.Term("f", "all"), cache.get(A.Term("f", "w1")))
        assert sorted(r["id"] for r in got.collect()) == [i for i in range(40) if i % 3 == 1]
    assert len(cache.kept) == 1
    cache.get(A.Term("f", "w2"))
    assert cache.get(A.SpanTerm("f", "w0"), spans=True).frame.columns == ["id", "spans"] and len(cache.kept) == 2
    cache.clear()
    assert len(within_time(docs.limit(3), 60)) == 3
    with pytest.raises(TimeExceeded):
        within_time(spark.range(0, 10**12, 1, 4).where("id % 7 = 9").agg(F.sum(F.sqrt("id"))), 1)


def test_payloads_and_positive_scores(spark):
    s = Searcher(ScanView(table(spark, ROWS[:3]), SCHEMA))
    assert {r["id"]: r["payloads"] for r in s.payloads(A.SpanNear((A.SpanTerm("f", "all"), A.SpanTerm("f", "all")), 0, True)).collect()} == {i: [3.0, 3.0] for i in range(3)}
    zero = A.CustomScore(A.MatchAll(), (), lambda score: F.lit(0.0))
    assert s.hits(zero).count() == 3 and s.hits(zero, positive=True).count() == 0


def test_stored_queries_read_the_documents_once(spark):
    docs = table(spark, ROWS)
    queries = {"a": A.Term("f", "w1"), "b": A.phrase("f", "all", "all"), "c": A.Prefix("f", "y3"), "d": A.all_of(A.Term("f", "w0"), A.Term("f", "x1"))}
    got = match_stored(docs, SCHEMA, queries)
    want = {("a", i) for i in range(40) if i % 3 == 1} | {("b", i) for i in range(40)} | {("c", i) for i in (3, *range(30, 40))} | {("d", i) for i in range(40) if i % 3 == 0 and i % 5 == 1}
    assert {(r["query"], r["id"]) for r in got.collect()} == want
    assert "Union" not in got._jdf.queryExecution().toString()


def marked(spark, text, analyzer, marker, **kw):
    return spark.createDataFrame([(text,)], "t string").select(H.highlight_field(F.col("t"), analyzer, marker, **kw)).first()[0]


def test_highlighting_by_analyzer(spark):
    stemmed = an.Analyzer(an.lowercase_letter, (an.stop(an.ENGLISH_STOP_WORDS), an.stem("porter")))
    assert marked(spark, "The Running dogs, running!", stemmed, H.TermMarker(A.Term("f", "run"))) == ["The <B>Running</B> dogs, <B>running</B>!"]
    q = A.phrase("f", "quick", "fox")
    text = "quick dog and quick fox and fox"
    assert marked(spark, text, an.SIMPLE, H.SpanMarker(q)) == ["quick dog and <B>quick</B> <B>fox</B> and fox"]
    assert marked(spark, text, an.SIMPLE, H.TermMarker(q)) == ["<B>quick</B> dog and <B>quick</B> <B>fox</B> and <B>fox</B>"]
    near = A.SpanNear((A.SpanTerm("f", "dog"), A.SpanTerm("f", "fox")), 2, True)
    assert marked(spark, text, an.SIMPLE, H.SpanMarker(A.SpanNot(near, A.SpanTerm("f", "zz")))) == ["quick <B>dog</B> and quick <B>fox</B> and fox"]
    assert marked(spark, "a <b> fox", an.SIMPLE, H.TermMarker(A.Term("f", "fox")), mark=H.gradient(1.0), encode=H.html_escape) == ['a &lt;b&gt; <font color="#FF0000">fox</font>']
    assert H.span_gradient(2.0)("x", 1.0) == '<span style="background: #FF8080">x</span>'
    grams = an.Analyzer(an.whitespace, (an.ngram_filter(2, 3),))
    row = spark.createDataFrame([("abcd xy",)], "t string").select(an.whitespace(F.col("t")).alias("raw"), grams(F.col("t")).alias("own")).first()
    tokens = H.tokens_of("abcd xy", [x["term"] for x in row["raw"]], [(x["term"], x["pos"]) for x in row["own"]])
    assert H.best_fragments("abcd xy", tokens, H.TermMarker(A.any_of(A.Term("f", "ab"), A.Term("f", "cd")))) == [("<B>abcd</B> xy", 2.0)]
    long = "word " * 60 + "fox jumps " + "word " * 60
    assert len(marked(spark, long, an.SIMPLE, H.TermMarker(A.Term("f", "fox")), fragmenter=H.whole)[0]) == len(long) + 7
    (part,) = marked(spark, long, an.SIMPLE, H.TermMarker(A.Term("f", "fox")), fragmenter=H.span_fragmenter(60))
    assert "<B>fox</B>" in part and len(part) < 120


def test_terms_of_expanded_queries(spark):
    view = ScanView(table(spark, ROWS), SCHEMA)
    assert H.query_terms(H.expanded(A.any_of(A.Prefix("f", "w"), A.ConstantScore(A.Term("f", "all"))), view)) == {"w0": 1.0, "w1": 1.0, "w2": 1.0, "all": 1.0}
    assert H.query_terms(A.any_of(A.Term("f", "a", 2.0), A.Term("g", "b")), idf=lambda t: 3.0, field="f") == {"a": 6.0}
