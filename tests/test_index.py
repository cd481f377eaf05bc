import pytest
from pyspark.sql import functions as F

from tesserae.functions import analysis as an
from tesserae.functions import codecs
from tesserae.operators.highlight import fragments, query_terms, tag
from tesserae.plans import ast as A
from tesserae.plans.search import ScanView, Searcher
from tesserae.schema import FieldSpec, Schema, keyword_field
from tesserae.sources.index import IndexReader, IndexWriter, commits, parallel

SCHEMA = Schema("id", {"f": FieldSpec("f", an.WHITESPACE), "k": keyword_field("k")})


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, f string, k string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    w = IndexWriter(spark, path, SCHEMA, create=True, keep=2)
    rows = [(1, "a b c", "x"), (2, "a a", "y"), (3, "c", "x")]
    w.add(frame(spark, rows))
    assert commits(spark, path) == [] and ids(w.reader().docs()) == [1, 2, 3]
    assert w.commit({"from": "test"}) == 1
    first = IndexReader.open(spark, path, SCHEMA)
    w.delete_terms("k", "x")
    w.add(frame(spark, [(4, "a", "x")]))
    assert first.is_current() and w.commit() == 2 and not first.is_current()
    assert ids(first.docs()) == [1, 2, 3] and ids(first.reopen().docs()) == [2, 4]
    w.update("k", "y", frame(spark, [(5, "a c", "y")]))
    assert ids(w.reader().docs()) == [4, 5]
    w.rollback()
    assert ids(w.reader().docs()) == [2, 4]
    w.optimize()
    assert w.commit() == 3 and ids(w.reader().docs()) == [2, 4] and commits(spark, path) == [2, 3]
    w.delete_all()
    with pytest.raises(ValueError):
        w.reader().docs()


def test_index_and_scan_agree(spark, tmp_path):
    docs = frame(spark, [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 2 + i % 6)), f"k{i % 3}") for i in range(1, 40)])
    w = IndexWriter(spark, f"file://{tmp_path}/index", SCHEMA, create=True)
    w.add(docs)
    w.commit()
    a, b = Searcher(w.reader()), Searcher(ScanView(docs, SCHEMA))
    for q in (A.any_of(A.Term("f", "w1"), A.Term("f", "w2", 2.0)), A.phrase("f", "w1", "w2"), A.Prefix("f", "w"), A.Prefix("f", "w", "scoring"), A.MatchAll("f"), A.Filtered(A.Term("f", "w3"), A.Term("k", "k1")), A.SpanNear((A.SpanTerm("f", "w1"), A.SpanTerm("f", "w3")), 3, False)):
        assert sorted(map(tuple, a.hits(q).collect())) == sorted(map(tuple, b.hits(q).collect())), str(q)


def test_parallel_needs_one_size(spark):
    x, y = frame(spark, [(1, "a", "b")]), spark.createDataFrame([(1, 2), (2, 3)], "id long, n long")
    with pytest.raises(ValueError):
        parallel(x, y, on="id")


def test_codecs(spark):
    values = [-(1 << 63), -5, -1, 0, 1, 35, 36, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", codecs.long_string(F.col("v")).alias("s"), codecs.prefix_coded(F.col("v")).alias("p"))
    rows = df.withColumn("back", codecs.string_long(F.col("s"))).collect()
    assert [r["back"] for r in rows] == values
    assert [r["v"] for r in sorted(rows, key=lambda r: r["s"])] == values == [r["v"] for r in sorted(rows, key=lambda r: r["p"])]
    assert {len(r["s"]) for r in rows} == {14}


def test_fragments():
    w = query_terms(A.Boolean((A.Clause(A.MUST, A.Term("f", "fox", 2.0)), A.Clause(A.MUST_NOT, A.Term("f", "dog")))))
    assert w == {"fox": 2.0}
    text = "the quick brown fox " + "filler word " * 20 + "another fox"
    got = fragments(text, w, 2, 40, tag(), lambda s: s)
    assert len(got) == 2 and all("<B>fox</B>" in f for f, _ in got)
    assert fragments("nothing here", w, 2, 40, tag(), lambda s: s) == []


def test_a_segment_of_one_file_is_made_by_all_cores(spark, tmp_path):
    import glob

    frame(spark, [(i, f"a w{i % 7}", "x") for i in range(200)]).coalesce(1).write.parquet(f"{tmp_path}/one")
    w = IndexWriter(spark, f"file://{tmp_path}/index", SCHEMA, create=True)
    w.add(spark.read.parquet(f"{tmp_path}/one"))
    assert len(glob.glob(f"{tmp_path}/index/segments/*/docs/part-*")) > 1
    assert not glob.glob(f"{tmp_path}/index/rewrite/*")
    assert w.reader().num_docs() == 200 and ids(w.reader().docs()) == list(range(200))
    assert w.reader().postings("f").count() == 400
