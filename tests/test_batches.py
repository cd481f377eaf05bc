"""Python steps of the analyzers over Arrow batches: the same tokens, and few of them as objects at once."""

import tracemalloc

import pyarrow as pa

from tesserae.functions import analysis as an
from tesserae.functions import stemmers


def peak_mb(step, batch):
    tracemalloc.start()
    try:
        return step(batch), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_stems_of_a_batch(monkeypatch):
    kind = pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())]))
    words = ["running", "flies", None, "sky", "relational"]
    rows = [None, [], *[[{"term": w, "pos": 2 * i} for i, w in enumerate(words[:n])] for n in (1, 5, 3)]]
    stemmed = [None if r is None else [{"term": x["term"] and stemmers.porter(x["term"]), "pos": x["pos"]} for x in r] for r in rows]
    step = an.stem("porter").func
    assert step(pa.array(rows, kind)).to_pylist() == stemmed
    assert step(pa.array(rows, kind).slice(1, 3)).to_pylist() == stemmed[1:4]
    monkeypatch.setattr(an, "TOKEN_BLOCK", 2)
    assert step(pa.array(rows, kind)).to_pylist() == stemmed
    assert step(pa.array([], kind)).to_pylist() == []


def test_stems_hold_few_objects():
    n = 200
    tokens = pa.StructArray.from_arrays([pa.array(["running"] * 2000 * n), pa.array(list(range(2000)) * n, pa.int32())], ["term", "pos"])
    batch = pa.ListArray.from_arrays(pa.array(range(0, 2000 * n + 1, 2000), pa.int32()), tokens)
    out, peak = peak_mb(an.stem("porter").func, batch)
    assert len(out) == n and out[n - 1][1999].as_py() == {"term": "run", "pos": 1999}
    assert peak < 20


def test_standard_tokens_hold_few_objects():
    texts = [None, "", *["AT&T's U.S.A. x-1, a@b.com " * 400] * 200]
    one = [{"term": t, "pos": p, "type": k} for t, p, k in an.standard_tokens(texts[2])]
    out, peak = peak_mb(an._standard_stream.func, pa.array(texts))
    assert out.slice(0, 3).to_pylist() == [[], [], one] and out[201].as_py() == one
    assert peak < 80
    assert an.standard_tokens("日本x 3.5 abcdef b", 4) == [("日", 0, "<CJ>"), ("本", 1, "<CJ>"), ("x", 2, "<ALPHANUM>"), ("3.5", 3, "<HOST>"), ("b", 5, "<ALPHANUM>")]


def test_term_vectors_are_made_within_rows(spark):
    from tesserae.operators.vectors import term_vectors
    from tesserae.plans.search import ScanView
    from tesserae.schema import FieldSpec, Schema

    docs = spark.createDataFrame([(1, "b a b c"), (2, ""), (3, "z z y")], "doc_id long, f string")
    view = ScanView(docs, Schema("doc_id", {"f": FieldSpec("f", an.WHITESPACE)}))
    v = term_vectors(view, "f")
    got = {r["doc_id"]: [tuple(e) for e in r["entries"]] for r in v.collect()}
    assert got == {1: [("b", 2, [0, 2]), ("a", 1, [1]), ("c", 1, [3])], 3: [("z", 2, [0, 1]), ("y", 1, [2])]}
    assert [r["doc_id"] for r in term_vectors(view, "f", lambda d: d > 1).collect()] == [3]
    assert "Exchange" not in v._jdf.queryExecution().executedPlan().toString()
