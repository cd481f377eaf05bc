"""Golden cases on small fixtures, and properties."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import analysis as an
from tesserae.functions.similarity import Similarity, decoded_norm
from tesserae.operators.highlight import fragments
from tesserae.operators.positions import near_ordered, near_unordered, sloppy_frequency
from tesserae.plans import ast as A
from tesserae.plans.search import ScanView, Searcher
from tesserae.schema import FieldSpec, Schema

DOCS = ["w1 w2 w3 w4 w5", "w1 w3 w2 w3 zz", "w1 xx w2 yy w3", "w1 w3 xx w2 yy w3 zz"]
SCHEMA = Schema("doc_id", {"f": FieldSpec("f", an.WHITESPACE)})


@pytest.fixture(scope="module")
def four(spark):
    return Searcher(ScanView(spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, f string"), SCHEMA))


def ids(s, q, **kw):
    return sorted(r["doc_id"] for r in s.hits(q, **kw).collect())


def t(x, b=1.0):
    return A.Term("f", x, b)


def test_boolean_matching(four):
    assert ids(four, t("xx")) == [2, 3]
    assert ids(four, A.all_of(t("xx"), t("zz"))) == [3]
    assert ids(four, A.any_of(t("xx"), t("zz"))) == [1, 2, 3]
    assert ids(four, A.Boolean((A.Clause(A.MUST, t("w1")), A.Clause(A.MUST_NOT, t("xx"))))) == [0, 1]
    assert ids(four, A.Boolean((A.Clause(A.MUST_NOT, t("xx")),))) == []
    assert ids(four, A.any_of(t("xx"), t("zz"), t("w5"), min_should=2)) == [3]
    assert ids(four, A.any_of(t("xx"), min_should=2)) == []
    with pytest.raises(A.TooManyClauses):
        A.any_of(*[t(str(i)) for i in range(1025)])


def test_phrases_and_spans(four):
    assert ids(four, A.phrase("f", "w1", "w3")) == [1, 3]
    assert ids(four, A.phrase("f", "w1", "w2", slop=1)) == [0, 1, 2]
    assert ids(four, A.phrase("f", "w3", "w2")) == [1]
    assert ids(four, A.Phrase("f", (("w2", "xx"), ("w3", "yy")))) == [0, 1, 2, 3]
    s = [A.SpanTerm("f", x) for x in ("w1", "w2", "w3")]
    assert ids(four, A.SpanNear(tuple(s), 0, True)) == [0]
    assert ids(four, A.SpanNear(tuple(s), 2, True)) == [0, 1, 2]
    assert ids(four, A.SpanNear(tuple(s), 3, False)) == [0, 1, 2, 3]
    assert ids(four, A.SpanFirst(s[2], 2)) == [1, 3]
    assert ids(four, A.SpanNot(s[1], A.SpanNear((A.SpanTerm("f", "xx"), s[1]), 0, True))) == [0, 1]


def test_multi_term(four):
    assert ids(four, A.Prefix("f", "x")) == [2, 3]
    assert ids(four, A.Wildcard("f", "?y")) == [2, 3]
    assert ids(four, A.TermRange("f", "w4", "w5", False, True)) == [0]
    assert ids(four, A.Fuzzy("f", "w5", 0.4)) == [0, 1, 2, 3]
    assert ids(four, A.MatchAll(), filter=t("zz")) == [1, 3]


def test_scores_follow_the_formula(four):
    got = {r["doc_id"]: r["score"] for r in four.hits(t("xx", 3.0)).collect()}
    idf = math.log(4 / 3) + 1
    # one term: its weight is normalised to 1, so idf counts once; five and seven tokens have norms 0.4375 and 0.375
    assert got == {2: round(idf * 0.4375, 6), 3: round(idf * 0.375, 6)}
    top = four.search(A.any_of(t("w3"), t("zz")), 2).collect()
    assert [r["doc_id"] for r in top] == [1, 3] and top[0]["score"] >= top[1]["score"]
    assert [r["doc_id"] for r in four.search(A.MatchAll(), 2, offset=1).collect()] == [1, 2]
    with pytest.raises(ValueError):
        four.search(t("xx"), 0)


def test_explain_holds_the_score(four):
    r = four.explain(t("xx")).where("doc_id = 2").first()
    f = r["factors"][0]
    assert r["score"] == round(math.sqrt(f["freq"]) * f["idf"] ** 2 * f["query_norm"] * f["field_norm"], 6)


def test_norm_bytes(spark):
    df = spark.range(1, 300).select("id", Similarity().norm(F.col("id")).alias("n"))
    got = {r["id"]: r["n"] for r in df.collect()}
    assert [got[n] for n in (1, 2, 3, 4, 5, 10, 100)] == [1.0, 0.625, 0.5, 0.5, 0.4375, 0.3125, 0.09375]
    assert spark.range(1).select(decoded_norm(F.lit(0.0))).first()[0] == 0


def test_proximity():
    assert near_unordered([[(0, 1), (5, 6)], [(2, 3)]], 1) == [(0, 3)]
    assert near_ordered([[(0, 1), (4, 5)], [(5, 6)]], 0) == [(4, 6)]
    assert near_ordered([[(5, 6)], [(0, 1)]], 9) == [] and near_ordered([[], [(0, 1)]], 9) == []
    assert sloppy_frequency([[0], [2]], (0, 1), 1, [0, 1]) == 0.5
    assert sloppy_frequency([[0], [1]], (0, 1), 3, [0, 1]) == 1.0
    assert sloppy_frequency([[1], [1]], (0, 1), 5, [0, 0]) == 0.0


def test_analyzers(spark):
    def terms(a, text):
        row = spark.createDataFrame([(text,)], "t string").select(a(F.col("t")).alias("s")).first()
        return [(x["term"], x["pos"]) for x in row["s"]]

    assert terms(an.stop_analyzer(), "The quick fox") == [("quick", 1), ("fox", 2)]
    assert [x for x, _ in terms(an.standard_analyzer(()), "AT&T O'Reilly's U.S.A. 216.239.63.104 a@b.com")] == ["at&t", "o'reilly", "usa", "216.239.63.104", "a@b.com"]
    assert [x for x, _ in terms(an.Analyzer(an.ngram(1, 2)), "abc")] == ["a", "ab", "b", "bc", "c"]
    assert [x for x, _ in terms(an.Analyzer(an.ngram(2, 3)), "abcde")] == ["ab", "abc", "bc", "bcd", "cd", "cde", "de"]
    assert [x for x, _ in terms(an.Analyzer(an.ngram(2, 3)), "a")] == [] and [x for x, _ in terms(an.edge_ngram_analyzer(1, 2, "back"), "abc")] == ["c", "bc"]
    assert [x for x, _ in terms(an.Analyzer(an.edge_ngram(1, 3)), "abcde")] == ["a", "ab", "abc"]
    assert [x for x, _ in terms(an.Analyzer(an.letter), "a" * 600)] == ["a" * 255, "a" * 255, "a" * 90]
    assert [x for x, _ in terms(an.Analyzer(an.cjk), "abc漢字語 d")] == ["abc", "漢字", "字語", "d"]
    assert [x for x, _ in terms(an.Analyzer(an.whitespace, (an.elision(),)), "l'avion qu'il")] == ["avion", "il"]
    assert [x for x, _ in terms(an.Analyzer(an.whitespace, (an.ascii_folding,)), "Ærø straße ﬁn")] == ["AEro", "strasse", "fin"]
    assert terms(an.Analyzer(an.whitespace, char_filter=an.char_map({"aa": "1", "aaa": "2"})), "aaaa") == [("2a", 0)]
    assert [x for x, _ in terms(an.Analyzer(an.lowercase_letter, (an.stem("porter"),)), "caresses ponies relational hopping happy sky")] == ["caress", "poni", "relat", "hop", "happi", "sky"]


def test_long_documents_are_searched_whole(spark):
    docs = spark.createDataFrame([(1, "w " * 12_000 + "far end"), (2, "w")], "doc_id long, f string")
    view = ScanView(docs, SCHEMA)
    assert [r["doc_id"] for r in Searcher(view).hits(A.Term("f", "end")).collect()] == [1]
    assert {r["term"]: r["cf"] for r in view.dictionary("f").collect()} == {"w": 12_001, "far": 1, "end": 1}
    capped = ScanView(docs, Schema("doc_id", {"f": FieldSpec("f", an.Analyzer(an.whitespace, max_tokens=10_000))}))
    assert {r["term"]: r["cf"] for r in capped.dictionary("f").collect()} == {"w": 10_001}
    values = ScanView(spark.createDataFrame([(1, ["w " * 12_000, "end"])], "doc_id long, f array<string>"), Schema("doc_id", {"f": FieldSpec("f", an.WHITESPACE, repeated=True)}))
    assert [r["doc_id"] for r in Searcher(values).hits(A.Term("f", "end")).collect()] == [1]


def test_long_texts_are_highlighted_whole():
    text = "filler " * 10_000 + "needle"
    marked = fragments(text, {"needle": 1.0}, 1, 100, lambda t: f"<{t}>", str)
    assert len(marked) == 1 and "<needle>" in marked[0][0]
    assert fragments(text, {"needle": 1.0}, 1, 100, lambda t: f"<{t}>", str, analyzed=50 * 1024) == []


def test_repeated_field_positions(spark):
    view = ScanView(spark.createDataFrame([(1, ["a b", "c"])], "doc_id long, f array<string>"), Schema("doc_id", {"f": FieldSpec("f", an.Analyzer(an.whitespace, position_gap=10), repeated=True)}))
    assert {r["term"]: r["positions"] for r in view.postings("f").collect()} == {"a": [0], "b": [1], "c": [12]}


def test_payloads(spark):
    paid = Schema("doc_id", {"f": FieldSpec("f", an.WHITESPACE, payload=lambda x: x["pos"] + 1)})
    s = Searcher(ScanView(spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, f string"), paid))
    w3 = A.SpanTerm("f", "w3")
    for fn, want in (("min", {0: 3.0, 1: 2.0, 2: 5.0, 3: 2.0}), ("max", {0: 3.0, 1: 4.0, 2: 5.0, 3: 6.0}), ("avg", {0: 3.0, 1: 3.0, 2: 5.0, 3: 4.0})):
        assert {r["doc_id"]: r["score"] for r in s.hits(A.Payload(w3, fn, include_span_score=False)).collect()} == want
    near = A.Payload(A.SpanNear((A.SpanTerm("f", "w1"), w3), 0, True), "avg", include_span_score=False)
    assert {r["doc_id"]: r["score"] for r in s.hits(near).collect()} == {1: 1.5, 3: 1.5}


def test_stemmers():
    from tesserae.functions.stemmers import by_name

    german, swedish = by_name("german"), by_name("swedish")
    assert [german(x) for x in ("aufeinanderfolgenden", "kategorie", "kategorisch", "katern", "katze", "jährlich")] == ["aufeinanderfolg", "kategori", "kategor", "kat", "katz", "jahrlich"]
    assert [swedish(x) for x in ("jaktkarlarne", "jaktkarlens", "klockorna")] == ["jaktkarl", "jaktkarl", "klock"]
    with pytest.raises(ValueError):
        by_name("klingon")


def test_language_analyzers(spark):
    def terms(a, text):
        return [x["term"] for x in spark.createDataFrame([(text,)], "t string").select(a(F.col("t")).alias("s")).first()["s"]]

    assert terms(an.german_analyzer(("und",), ("katern",)), "Katzen und katern") == ["katz", "katern"]
    assert terms(an.greek_analyzer(()), "Αθήνα ΌΧΙ") == ["αθηνα", "οχι"]
    assert terms(an.chinese_analyzer(), "a 漢字 abc 12") == ["漢", "字", "abc", "12"]
    assert terms(an.persian_analyzer(), "کتاب") == ["كتاب"]
    from tesserae.functions.stemmers import danish, norwegian

    assert [norwegian(x) for x in ("havnedistriktene", "opninger")] == ["havnedistrikt", "opning"]
    assert [danish(x) for x in ("indtager", "undersøgelser")] == ["indtag", "undersøg"]
