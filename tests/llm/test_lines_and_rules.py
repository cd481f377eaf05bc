import collections
import re

from pyspark.sql import functions as F

from tesserae.llm.linededup import keep_bitmaps, line_dedup
from tesserae.llm.quality import quality_filter, quality_rules
from tests.llm.data import SF, awkward, empty

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(WHITE))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_lines_of_common_keys_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = collections.defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            seen[key(line)].add(i)
    got = by_id(line_dedup(docs, 3, 1, False))
    for i, t in texts.items():
        kept = [x for x in t.split("\n") if not key(x) or len(seen[key(x)]) < 3]
        assert (got[i]["text"], got[i]["n_lines"]) == ("\n".join(kept), t.count("\n") + 1)


def test_heavy_lines_and_first_occurrence(spark):
    # one line a third of all rows, so that it takes the path of heavy keys
    rows = [(i, "\n".join(["Common  line ", f"own {i}", f"pair {i // 2}", "common  line"])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(line_dedup(docs, 2, 1, True))
    first = {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            if first.setdefault(key(line), i) == i and not (key(line) == "common  line" and (i > 0 or kept)):
                kept.append(line)
        assert got[i]["text"] == "\n".join(kept), i
    runs = by_id(keep_bitmaps(docs, 2, 1, False))
    assert [tuple(x) for x in runs[7]["dropped"]] == [(0, 0), (2, 3)]


def test_rules_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = by_id(quality_rules(docs))
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = collections.defaultdict(list)
        for k in range(len(w) - 4):
            windows[tuple(w[k : k + 5])].append(k)
        covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip(WHITE)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        g = got[i]
        assert want == (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"])
        assert g["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (g["base_failed"] and g["kept"])
    assert {r["doc_id"] for r in quality_filter(docs).collect()} == {i for i, g in got.items() if g["kept"]}


def test_rules_follow_the_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    good = quality_rules(docs).where(~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, good))
    assert share[1] > 0.99 and share.get(0, 0) < 0.1


def test_edges(spark):
    docs = awkward(spark)
    n = docs.count()
    lines = line_dedup(docs, 2, 1, True)
    assert lines.count() == n and set(docs.columns) <= set(lines.columns)
    assert {r["text"] for r in lines.where("doc_id = 0").collect()} == {""}
    assert quality_rules(docs).count() == n
    assert not quality_rules(docs).where("doc_id = 0").first()["kept"]
    assert quality_filter(docs).columns == docs.columns
    for op in (line_dedup, keep_bitmaps, quality_rules, quality_filter):
        assert op(empty(spark)).count() == 0
