"""The registered search queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import analysis as an
from tesserae.plans import ast as A
from tesserae.plans.search import DOC_ORDER, ColumnFilter, DocSet, ScanView, Searcher, SortField, spread
from tesserae.schema import FieldSpec, Schema, keyword_field, numeric_field

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DOCS = Schema(
    "doc_id",
    {
        "text": FieldSpec("text", an.SIMPLE),
        "stopped": FieldSpec("text", an.stop_analyzer()),
        "lang": keyword_field("lang"),
        "source": keyword_field("source"),
    },
)


def register(name: str, sql: str | None = None) -> Callable:
    def put(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def searcher(spark: SparkSession, sf_dir: str) -> Searcher:
    return Searcher(ScanView(spread(table(spark, sf_dir, "documents")), DOCS))


# --- SQL pieces --------------------------------------------------------------------------------

# Tokens are cut at 255 characters; none here is that long, and SQL engines are slow at bounded repeats.
NORM = "CASE WHEN x <= 0 THEN 0 ELSE pow(2, floor(log2(x))) * floor(4 * x / pow(2, floor(log2(x)))) / 4 END"
TOKENS = """d AS MATERIALIZED (SELECT doc_id, lang, source, n_chars, regexp_extract_all(lower(text), '\\p{L}+') AS ts FROM documents),
t AS MATERIALIZED (SELECT doc_id, (i - 1)::INT AS pos, ts[i] AS term FROM d, unnest(range(1, len(ts) + 1)) AS u(i))"""
PRELUDE = f"""{TOKENS},
p AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id),
n AS MATERIALIZED (SELECT doc_id, CASE WHEN x IS NOT NULL THEN {NORM} ELSE 7516192768.0 END AS norm FROM (SELECT doc_id, CASE WHEN len(ts) > 0 THEN 1 / sqrt(len(ts)) END AS x FROM d)),
st AS (SELECT count(*) AS max_doc FROM documents)"""


def weights(terms: dict[str, float], extra: str = "0") -> str:
    """CTEs w (a row per query term) and h (a row per matching document and term); extra squares join the norm."""
    values = ", ".join(f"('{t}', {b})" for t, b in terms.items())
    return f"""{PRELUDE},
q(term, b) AS (VALUES {values}),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM p WHERE term IN ({', '.join(f"'{t}'" for t in terms)}) GROUP BY term),
w0 AS MATERIALIZED (SELECT q.term, b, ln(max_doc / (coalesce(df, 0) + 1)) + 1 AS idf FROM q LEFT JOIN df USING (term), st),
qn AS (SELECT 1 / sqrt(sum(b * b * idf * idf) + {extra}) AS qn FROM w0),
w AS MATERIALIZED (SELECT term, b, idf, qn * b * idf * idf AS v FROM w0, qn),
h AS MATERIALIZED (SELECT doc_id, term, tf, sqrt(tf) * v * norm AS s FROM p JOIN w USING (term) JOIN n USING (doc_id))"""


def topk(n: int) -> str:
    return f"ORDER BY score DESC, doc_id LIMIT {n}"


def hits(name: str, query: A.Query, sql: str | None, **kw) -> None:
    """Registers all hits of a query."""
    register(name, sql)(lambda spark, sf_dir: searcher(spark, sf_dir).hits(query, **kw))


THE_OF_AND = A.any_of(A.Term("text", "the"), A.Term("text", "of"), A.Term("text", "and"))
OR3 = f"WITH {weights({'the': 1, 'of': 1, 'and': 1})}, r AS (SELECT doc_id, round(sum(s) * count(*) / 3, 6) AS score FROM h GROUP BY doc_id)"

register("term_topk", f"{OR3} SELECT doc_id, score FROM r {topk(10)}")(lambda spark, sf_dir: searcher(spark, sf_dir).search(THE_OF_AND, 10))
register("paging", f"{OR3} SELECT doc_id, score FROM r {topk(10)} OFFSET 20")(lambda spark, sf_dir: searcher(spark, sf_dir).search(THE_OF_AND, 10, offset=20))
register("total_hits", f"{OR3} SELECT count(*) AS total_hits, max(score) AS max_score FROM r")(lambda spark, sf_dir: searcher(spark, sf_dir).totals(THE_OF_AND))
hits("boolean_should", THE_OF_AND, f"{OR3} SELECT * FROM r")
hits("term_query", A.Term("text", "with", 2.0), f"WITH {weights({'with': 2})} SELECT doc_id, round(s, 6) AS score FROM h")
hits("boolean_must", A.all_of(A.Term("text", "the"), A.Term("text", "with")), f"WITH {weights({'the': 1, 'with': 1})} SELECT doc_id, round(sum(s), 6) AS score FROM h GROUP BY doc_id HAVING count(*) = 2")
hits(
    "boolean_must_should",
    A.Boolean((A.Clause(A.MUST, A.Term("text", "the")), A.Clause(A.SHOULD, A.Term("text", "from", 3.0)))),
    f"WITH {weights({'the': 1, 'from': 3})} SELECT doc_id, round(sum(s) * count(*) / 2, 6) AS score FROM h GROUP BY doc_id HAVING bool_or(term = 'the')",
)
hits(
    "boolean_must_not",
    A.Boolean((A.Clause(A.MUST, A.Term("text", "the")), A.Clause(A.MUST_NOT, A.Term("text", "with")))),
    f"WITH {weights({'the': 1})} SELECT doc_id, round(s, 6) AS score FROM h WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'with')",
)
hits(
    "boolean_min_should",
    A.any_of(A.Term("text", "the"), A.Term("text", "of"), A.Term("text", "le"), A.Term("text", "from"), min_should=2),
    f"WITH {weights({'the': 1, 'of': 1, 'le': 1, 'from': 1})} SELECT doc_id, round(sum(s) * count(*) / 4, 6) AS score FROM h GROUP BY doc_id HAVING count(*) >= 2",
)
hits(
    "boolean_no_coord",
    A.any_of(A.Term("text", "le"), A.Term("text", "und"), disable_coord=True),
    f"WITH {weights({'le': 1, 'und': 1})} SELECT doc_id, round(sum(s), 6) AS score FROM h GROUP BY doc_id",
)
hits(
    "boolean_unknown_term",
    A.any_of(A.Term("text", "the"), A.Term("text", "xqzzyunknown")),
    f"WITH {weights({'the': 1, 'xqzzyunknown': 1})} SELECT doc_id, round(sum(s) / 2, 6) AS score FROM h GROUP BY doc_id",
)
hits(
    "boolean_nested",
    A.Boolean((A.Clause(A.MUST, A.Term("text", "the")), A.Clause(A.MUST, A.any_of(A.Term("text", "with"), A.Term("text", "from"))))),
    f"WITH {weights({'the': 1, 'with': 1, 'from': 1})}, i AS (SELECT doc_id, sum(s) * count(*) / 2 AS s FROM h WHERE term <> 'the' GROUP BY doc_id) "
    "SELECT doc_id, round(h.s + i.s, 6) AS score FROM h JOIN i USING (doc_id) WHERE term = 'the'",
)
hits(
    "dismax",
    A.DisMax((A.Term("text", "the"), A.Term("text", "with", 2.0)), tie=0.1),
    f"""WITH {PRELUDE}, q(term, b) AS (VALUES ('the', 1), ('with', 2)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w0 AS (SELECT q.term, b, ln(max_doc / (coalesce(df, 0) + 1)) + 1 AS idf FROM q LEFT JOIN df USING (term), st),
qn AS (SELECT 1 / sqrt((sum(b * b * idf * idf) - max(b * b * idf * idf)) * 0.1 * 0.1 + max(b * b * idf * idf)) AS qn FROM w0),
h AS (SELECT doc_id, sqrt(tf) * qn * b * idf * idf * norm AS s FROM p JOIN w0 USING (term) JOIN n USING (doc_id), qn)
SELECT doc_id, round(max(s) + (sum(s) - max(s)) * 0.1, 6) AS score FROM h GROUP BY doc_id""",
)


# phrases and spans
def phrase_sql(freq: str, terms: list[str]) -> str:
    """Hits scored by a CTE f(doc_id, freq); idf sums over the terms."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH {PRELUDE}, q(term) AS (VALUES {values}),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT sum(ln(max_doc / (coalesce(df, 0) + 1)) + 1) AS idf FROM q LEFT JOIN df USING (term), st),
f AS ({freq})
SELECT doc_id, round(sqrt(freq) * idf * norm, 6) AS score FROM f JOIN n USING (doc_id), i"""


hits("phrase_exact", A.phrase("text", "of", "the"), phrase_sql("SELECT a.doc_id, count(*) AS freq FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id", ["of", "the"]))
hits(
    "phrase_gap",
    A.Phrase("text", (("the",), ("of",)), (0, 2)),
    phrase_sql("SELECT a.doc_id, count(*) AS freq FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = 'the' AND b.term = 'of' GROUP BY a.doc_id", ["the", "of"]),
)
hits(
    "multi_phrase",
    A.Phrase("text", (("the", "a"), ("of", "and", "in"))),
    phrase_sql("SELECT a.doc_id, count(DISTINCT a.pos) AS freq FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term IN ('the', 'a') AND b.term IN ('of', 'and', 'in') GROUP BY a.doc_id", ["the", "a", "of", "and", "in"]),
)
# Values are places less the slot, equal ones one event.  A run passes over to the other slot at its next value, and
# once within each event of both; windows are the steps from one slot to the other.
SLOPPY2 = """SELECT doc_id, freq FROM (SELECT doc_id, sum(CASE WHEN n = 2 THEN 1 WHEN before >= 0 AND before <> k AND v - pv <= 3 THEN 1 / (1 + v - pv) ELSE 0 END) AS freq FROM (
 SELECT *, coalesce(lag(run) OVER (PARTITION BY doc_id ORDER BY v), -1) AS before FROM (
  SELECT *, CASE WHEN grp > 0 THEN (k0 + m) % 2 ELSE m % 2 END AS run FROM (
   SELECT *, first_value(k) OVER (PARTITION BY doc_id, grp ORDER BY v) AS k0, row_number() OVER (PARTITION BY doc_id, grp ORDER BY v) - (grp > 0)::INT AS m FROM (
    SELECT *, sum((n = 1)::INT) OVER (PARTITION BY doc_id ORDER BY v) AS grp, lag(v) OVER (PARTITION BY doc_id ORDER BY v) AS pv FROM (
     SELECT doc_id, pos - (term = 'of')::INT AS v, count(*) AS n, max((term = 'of')::INT) AS k FROM t WHERE term IN ('the', 'of') GROUP BY doc_id, pos - (term = 'of')::INT))))) GROUP BY doc_id) WHERE freq > 0"""
hits("phrase_sloppy", A.phrase("text", "the", "of", slop=3), phrase_sql(SLOPPY2, ["the", "of"]))


def st(term: str) -> A.SpanTerm:
    return A.SpanTerm("text", term)


def span_sql(spans: str, terms: list[str]) -> str:
    """Hits scored by spans(doc_id, s, e)."""
    return phrase_sql(f"SELECT doc_id, sum(1 / (1 + e - s)) AS freq FROM ({spans}) GROUP BY doc_id", terms)


def one(term: str) -> str:
    return f"SELECT doc_id, pos AS s, pos + 1 AS e FROM t WHERE term = '{term}'"


hits("span_term", st("with"), span_sql(one("with"), ["with"]))
hits("span_or", A.SpanOr((st("with"), st("from"))), span_sql(f"{one('with')} UNION ALL {one('from')}", ["with", "from"]))
hits("span_first", A.SpanFirst(st("the"), 10), span_sql(f"SELECT * FROM ({one('the')}) WHERE e <= 10", ["the"]))
NEAR2 = """SELECT doc_id, s, e FROM (SELECT *, lead(s) OVER (PARTITION BY doc_id, e ORDER BY s) AS later FROM (
  SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos > a.pos
  WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id, a.pos)) WHERE later IS NULL AND e - s - 2 <= 2"""
hits("span_near_ordered", A.SpanNear((st("of"), st("the")), 2, True), span_sql(NEAR2, ["of", "the"]))
register(
    "span_near_unordered_docs",
    f"WITH {TOKENS} SELECT DISTINCT a.doc_id FROM t a JOIN t b ON a.doc_id = b.doc_id WHERE a.term = 'of' AND b.term = 'with' AND abs(a.pos - b.pos) - 1 <= 3",
)(lambda spark, sf_dir: searcher(spark, sf_dir).hits(A.SpanNear((st("of"), st("with")), 3, False)).select("doc_id"))
hits(
    "span_not",
    A.SpanNot(st("the"), A.SpanNear((st("of"), st("the")), 0, True)),
    span_sql(f"SELECT * FROM ({one('the')}) x WHERE NOT EXISTS (SELECT 1 FROM t y WHERE y.doc_id = x.doc_id AND y.term = 'of' AND y.pos = x.s - 1)", ["the"]),
)
MASK2 = """SELECT doc_id, s, e FROM (SELECT *, lead(s) OVER (PARTITION BY doc_id, e ORDER BY s) AS later FROM (
  SELECT a.doc_id, a.pos AS s, min(b.pos) + 1 AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos > a.pos
  WHERE a.term = 'of' AND b.term = 'from' GROUP BY a.doc_id, a.pos)) WHERE later IS NULL AND e - s - 2 <= 60"""
hits("field_mask", A.SpanNear((st("of"), A.FieldMask(A.SpanTerm("stopped", "from"), "text")), 60, True), span_sql(MASK2, ["of", "from"]))

# payloads: every token carries its length
PAID = Schema("doc_id", {"text": FieldSpec("text", an.SIMPLE, payload=lambda t: F.length(t["term"]) + t["pos"] % 3)})
WITH_HITS = f"WITH {weights({'with': 1})}, pay AS (SELECT doc_id, avg(4 + pos % 3) AS a, max(4 + pos % 3) AS m FROM t WHERE term = 'with' GROUP BY doc_id)"
register("payload_term", f"{WITH_HITS} SELECT doc_id, round(s / sqrt(2) * a, 6) AS score FROM h JOIN pay USING (doc_id)")(
    lambda spark, sf_dir: Searcher(ScanView(spread(table(spark, sf_dir, "documents")), PAID)).hits(A.Payload(st("with"), "avg"))
)
register("payload_only", f"{WITH_HITS} SELECT doc_id, m::DOUBLE AS score FROM h JOIN pay USING (doc_id)")(
    lambda spark, sf_dir: Searcher(ScanView(spread(table(spark, sf_dir, "documents")), PAID)).hits(A.Payload(st("with"), "max", include_span_score=False))
)

# multi-term queries
CONST = "SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM t WHERE "
hits("prefix_query", A.Prefix("text", "tion"), f"WITH {TOKENS} {CONST} starts_with(term, 'tion')")
hits("wildcard_query", A.Wildcard("text", "t?e*n"), f"WITH {TOKENS} {CONST} regexp_full_match(term, 't.e.*n')")
hits("term_range", A.TermRange("text", "ze", "zu", True, False), f"WITH {TOKENS} {CONST} term >= 'ze' AND term < 'zu'")
hits("term_range_open", A.TermRange("lang", None, "es", True, True), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang <= 'es'")
hits("numeric_range", A.NumericRange("n_chars", 500, 2000, True, False), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars >= 500 AND n_chars < 2000")
hits("match_all", A.MatchAll(boost=2.0), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
hits("constant_score", A.ConstantScore(A.Term("text", "with"), 3.0), f"WITH {TOKENS} {CONST} term = 'with'")


def scored_set(test: str) -> str:
    """A weighted disjunction, without coordination, over CTE q(term, b) of expanded terms."""
    return f"""WITH {PRELUDE}, q AS (SELECT term, 1.0 AS b FROM p WHERE {test} GROUP BY term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w0 AS (SELECT q.term, b, ln(max_doc / (df + 1)) + 1 AS idf FROM q JOIN df USING (term), st),
qn AS (SELECT 1 / sqrt(sum(b * b * idf * idf)) AS qn FROM w0)
SELECT doc_id, round(sum(sqrt(tf) * qn * b * idf * idf * norm), 6) AS score FROM p JOIN w0 USING (term) JOIN n USING (doc_id), qn GROUP BY doc_id"""


hits("prefix_scoring", A.Prefix("text", "zuau", "scoring"), scored_set("starts_with(term, 'zuau')"))
FUZZY = """SELECT term, sim - 0.6 AS b0 FROM (SELECT term, 1 - levenshtein(term, 'thenth') / least(length(term), 6) AS sim FROM (SELECT DISTINCT term FROM p)) WHERE sim > 0.6 ORDER BY sim DESC, term LIMIT 1024"""
hits(
    "fuzzy_query",
    A.Fuzzy("text", "thenth", 0.6),
    f"""WITH {PRELUDE}, q AS (SELECT term, b0 * (1 / (1 - 0.6)) AS b FROM ({FUZZY})),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w0 AS (SELECT q.term, b, ln(max_doc / (df + 1)) + 1 AS idf FROM q JOIN df USING (term), st),
qn AS (SELECT 1 / sqrt(sum(b * b * idf * idf)) AS qn FROM w0)
SELECT doc_id, round(sum(sqrt(tf) * qn * b * idf * idf * norm), 6) AS score FROM p JOIN w0 USING (term) JOIN n USING (doc_id), qn GROUP BY doc_id""",
)

# filters and sets
LONG = ColumnFilter("n_chars >= 3000", ("n_chars",), lambda c: c >= 3000)
hits("filtered_query", A.Filtered(A.Term("text", "the"), LONG, 2.0), f"WITH {weights({'the': 1}, '0')} SELECT doc_id, round(h.s / 2 * 2, 6) AS score FROM h JOIN documents USING (doc_id) WHERE n_chars >= 3000")
hits("query_filter", A.Term("text", "the"), f"WITH {weights({'the': 1})} SELECT doc_id, round(s, 6) AS score FROM h WHERE doc_id IN (SELECT doc_id FROM p WHERE term = 'with')", filter=A.Term("text", "with"))
hits("terms_filter", A.MatchAll(), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE source IN ('src1', 'src3')", filter=ColumnFilter("source", ("source",), lambda c: c.isin("src1", "src3")))


@register("doc_set_filter", f"WITH {weights({'the': 1})} SELECT doc_id, round(s, 6) AS score FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def doc_set_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return searcher(spark, sf_dir).hits(A.Term("text", "the"), DocSet("good", good))


@register("span_filter", f"WITH {TOKENS} SELECT doc_id, count(*) AS n_spans, min(pos) AS first_start FROM t WHERE term = 'with' GROUP BY doc_id")
def span_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.filters import span_positions

    found = span_positions(searcher(spark, sf_dir).view, st("with"))
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.col("spans")[0]["s"].alias("first_start"))


# value sources and custom scores
hits("field_score", A.FieldScore(A.ValueSource("n_chars"), 2.0), "SELECT doc_id, n_chars::DOUBLE AS score FROM documents")
hits("ord_source", A.FieldScore(A.ValueSource("source", "ord")), "SELECT doc_id, dense_rank() OVER (ORDER BY source)::DOUBLE AS score FROM documents")
hits("rord_source", A.FieldScore(A.ValueSource("source", "rord")), "SELECT doc_id, dense_rank() OVER (ORDER BY source DESC)::DOUBLE AS score FROM documents")
hits(
    "custom_score",
    A.CustomScore(A.Term("text", "the"), (A.FieldScore(A.ValueSource("n_chars")),), lambda s, v: s * F.log(v + 1), strict=True),
    f"WITH {weights({'the': 1})} SELECT doc_id, round(s * ln(n_chars + 1), 6) AS score FROM h JOIN documents USING (doc_id)",
)
register("value_stats", "SELECT min(n_chars)::DOUBLE AS min_value, max(n_chars)::DOUBLE AS max_value, round(avg(n_chars), 6) AS avg_value FROM documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").agg(F.min("n_chars").cast("double").alias("min_value"), F.max("n_chars").cast("double").alias("max_value"), F.round(F.avg("n_chars"), 6).alias("avg_value"))
)

# sorting
register("sort_fields", f"WITH {TOKENS} SELECT DISTINCT doc_id, source, n_chars FROM t JOIN documents USING (doc_id) WHERE term = 'the' ORDER BY source, n_chars DESC, doc_id LIMIT 25")(
    lambda spark, sf_dir: searcher(spark, sf_dir).search(A.Term("text", "the"), 25, sort=(SortField("string", "source"), SortField("long", "n_chars", reverse=True)), columns=("source", "n_chars")).drop("score")
)
register("sort_doc_order", f"WITH {TOKENS} SELECT DISTINCT doc_id FROM t WHERE term = 'with' ORDER BY doc_id LIMIT 15")(lambda spark, sf_dir: searcher(spark, sf_dir).search(A.Term("text", "with"), 15, sort=(DOC_ORDER,)).select("doc_id"))


# statistics
@register("term_stats", f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searcher(spark, sf_dir).view.dictionary("text")


@register("postings", f"WITH {TOKENS} SELECT term, doc_id, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM t GROUP BY term, doc_id")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = searcher(spark, sf_dir).view.postings("text")
    return p.select("term", F.col("__doc").alias("doc_id"), "tf", F.col("positions")[0].alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


@register("term_enumeration", f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM t WHERE term >= 'the' GROUP BY term ORDER BY term LIMIT 50")
def term_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searcher(spark, sf_dir).view.dictionary("text").where("term >= 'the'").select("term", "df").orderBy("term").limit(50)


@register("term_vectors", f"WITH {TOKENS} SELECT doc_id, term, count(*) AS freq, (row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term)) AS place FROM t GROUP BY doc_id, term")
def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.vectors import term_vectors as vectors

    v = vectors(searcher(spark, sf_dir).view, "text")
    return v.select("doc_id", F.posexplode("entries").alias("k", "e")).select("doc_id", "e.term", "e.freq", (F.col("k") + 1).cast("long").alias("place"))


@register("check_index", f"WITH {TOKENS}, p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id) SELECT count(DISTINCT term) AS n_terms, count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens, 0::BIGINT AS n_bad FROM p")
def check_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources.index import audit

    return audit(searcher(spark, sf_dir).view.postings("text"))


# --- analysis ----------------------------------------------------------------------------------


def token_stats(name: str, analyzer: an.Analyzer, sql_tokens: str | None) -> None:
    """Registers (term, df, cf) under an analyzer; sql_tokens is a list expression over text."""
    sql = f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({sql_tokens}) AS term FROM documents) GROUP BY term" if sql_tokens else None

    @register(f"analyze_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents"))
        view = ScanView(docs, Schema("doc_id", {"f": FieldSpec("text", analyzer)}))
        return view.dictionary("f")


STOPS = ", ".join(f"'{w}'" for w in an.ENGLISH_STOP_WORDS)
token_stats("whitespace", an.WHITESPACE, "regexp_extract_all(text, '[^\\p{Z}\\t\\n\\r\\f]+')")
token_stats("letter", an.Analyzer(an.letter), "regexp_extract_all(text, '\\p{L}+')")
token_stats("stop", an.stop_analyzer(), f"list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda x: x NOT IN ({STOPS}))")
token_stats("length", an.Analyzer(an.lowercase_letter, (an.length(4, 9),)), "list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: length(x) BETWEEN 4 AND 9)")
token_stats("reverse", an.Analyzer(an.lowercase_letter, (an.reverse,)), "list_transform(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: reverse(x))")
token_stats("folding", an.Analyzer(an.lowercase_letter, (an.ascii_folding,)), "list_transform(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: replace(strip_accents(x), 'ß', 'ss'))")
token_stats("edge_ngram", an.Analyzer(an.lowercase_letter, (an.edge_ngram_filter(2, 3),)), "list_concat(list_transform(list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: length(x) >= 2), lambda x: left(x, 2)), list_transform(list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: length(x) >= 3), lambda x: left(x, 3)))")
token_stats("russian_letter", an.Analyzer(an.russian_letter), "regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')")
token_stats("arabic_letter", an.Analyzer(an.arabic_letter), "regexp_extract_all(text, '[\\p{L}\\p{Mn}]+')")
token_stats("standard", an.standard_analyzer(), None)
token_stats("porter", an.Analyzer(an.lowercase_letter, (an.stem("porter"),)), None)
token_stats("elision", an.Analyzer(an.whitespace, (an.elision(),)), "list_transform(regexp_extract_all(text, '[^\\p{Z}\\t\\n\\r\\f]+'), lambda x: regexp_replace(x, '^(?i:qu|l|m|t|n|s|j)[''’]', ''))")
register("analyze_keyword", "SELECT lang AS term, count(*) AS df, count(*) AS cf FROM documents GROUP BY lang")(lambda spark, sf_dir: searcher(spark, sf_dir).view.dictionary("lang"))
register(
    "analyze_ngram",
    "SELECT term, count(DISTINCT c_custkey) AS df, count(*) AS cf FROM (SELECT c_custkey, unnest(list_concat(list_transform(range(1, length(c_name) + 1), lambda i: c_name[i:i]), list_transform(range(1, length(c_name)), lambda i: c_name[i:i+1]))) AS term FROM customer) GROUP BY term",
)(lambda spark, sf_dir: ScanView(table(spark, sf_dir, "customer"), Schema("c_custkey", {"f": FieldSpec("c_name", an.Analyzer(an.ngram(1, 2)))})).dictionary("f"))


# --- index maintenance -------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return f"{root.rstrip('/')}/index-{uuid.uuid4().hex}"


PARTS = Schema("p_partkey", {"name": FieldSpec("p_name", an.WHITESPACE), "brand": keyword_field("p_brand"), "type": FieldSpec("p_type", an.SIMPLE)})
PART_TERMS = "regexp_extract_all(p_name, '[^\\p{Z}\\t\\n\\r\\f]+')"


def part_index(spark: SparkSession, sf_dir: str, path: str | None = None):
    from tesserae.sources.index import IndexWriter

    parts = table(spark, sf_dir, "part")
    w = IndexWriter(spark, path or scratch(spark), PARTS, create=True)
    w.add(parts.where("p_partkey % 2 = 0"))
    w.add(parts.where("p_partkey % 2 = 1"))
    return w


def first_term(spark: SparkSession, sf_dir: str) -> str:
    return table(spark, sf_dir, "part").agg(F.min(F.split("p_name", " ")[0])).first()[0]


@register(
    "index_search",
    f"""WITH d AS (SELECT p_partkey, {PART_TERMS} AS ts FROM part), t AS (SELECT p_partkey, unnest(ts) AS term FROM d),
q AS (SELECT min(string_split(p_name, ' ')[1]) AS term FROM part), p AS (SELECT p_partkey, count(*) AS tf FROM t JOIN q USING (term) GROUP BY p_partkey),
i AS (SELECT ln((SELECT count(*) FROM part) / (count(*) + 1)) + 1 AS idf FROM p),
n AS (SELECT p_partkey, {NORM} AS norm FROM (SELECT p_partkey, 1 / sqrt(len(ts)) AS x FROM d WHERE len(ts) > 0))
SELECT p_partkey, round(sqrt(tf) * idf * norm, 6) AS score FROM p JOIN n USING (p_partkey), i""",
)
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = part_index(spark, sf_dir)
    w.commit()
    return Searcher(w.reader()).hits(A.Term("name", first_term(spark, sf_dir)))


@register("index_delete", "SELECT p_partkey, p_brand FROM part WHERE p_brand <> (SELECT min(p_brand) FROM part)")
def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = part_index(spark, sf_dir)
    w.delete_terms("brand", table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0])
    w.commit()
    return w.reader().docs().select("p_partkey", "p_brand")


@register("index_update", "SELECT CASE WHEN p_brand = (SELECT max(p_brand) FROM part) THEN p_partkey + 1000000 ELSE p_partkey END AS p_partkey, p_brand FROM part")
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = part_index(spark, sf_dir)
    parts = table(spark, sf_dir, "part")
    last = parts.agg(F.max("p_brand")).first()[0]
    w.update("brand", last, parts.where(F.col("p_brand") == last).withColumn("p_partkey", F.col("p_partkey") + 1000000))
    w.commit()
    w.optimize()
    w.commit()
    return w.reader().docs().select("p_partkey", "p_brand")


@register("multi_reader", "SELECT id, name FROM (SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1000000 + c_custkey, c_name FROM customer) WHERE name LIKE '%1%'")
def multi_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources.index import multi

    both = multi(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000).alias("id"), F.col("c_name").alias("name")))
    s = Searcher(ScanView(both, Schema("id", {"name": keyword_field("name")})))
    return s.hits(A.Wildcard("name", "*1*"), columns=("name",)).drop("score")


@register("parallel_reader", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def parallel_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources.index import parallel

    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    return parallel(docs.select("doc_id", "lang"), labels.select("doc_id", "quality"))


@register("repeated_field", "WITH t AS (SELECT conv_id, lower(text) AS s FROM conversations), u AS (SELECT conv_id, unnest(regexp_extract_all(s, '\\p{L}+')) AS term FROM t) SELECT term, count(DISTINCT conv_id) AS df, count(*) AS cf FROM u GROUP BY term")
def repeated_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return ScanView(turns, Schema("conv_id", {"turns": FieldSpec("turns", an.SIMPLE, repeated=True)})).dictionary("turns")


# --- sets, codecs, highlighting, stored queries -------------------------------------------------


def docs_with(spark: SparkSession, sf_dir: str, term: str) -> DataFrame:
    return searcher(spark, sf_dir).hits(A.Term("text", term)).select("doc_id")


def set_query(name: str, op: str, sql: str) -> None:
    @register(name, f"WITH {TOKENS}, a AS (SELECT DISTINCT doc_id FROM t WHERE term = 'with'), b AS (SELECT DISTINCT doc_id FROM t WHERE term = 'from') {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tesserae.operators import filters

        return getattr(filters, op)(docs_with(spark, sf_dir, "with"), docs_with(spark, sf_dir, "from"))


set_query("set_and", "both", "SELECT * FROM a INTERSECT SELECT * FROM b")
set_query("set_or", "either", "SELECT * FROM a UNION SELECT * FROM b")
set_query("set_and_not", "without", "SELECT * FROM a EXCEPT SELECT * FROM b")
set_query("set_xor", "one_of", "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)")


@register("set_not", f"WITH {TOKENS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t WHERE term = 'with')")
def set_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.filters import flipped

    return flipped(docs_with(spark, sf_dir, "with"), table(spark, sf_dir, "documents").select("doc_id"))


@register("date_strings", "SELECT event_id, strftime(ts, '%Y') AS y, strftime(ts, '%Y%m%d') AS d, strftime(ts, '%Y%m%d%H%M%S') AS s FROM events")
def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions.codecs import date_string

    return table(spark, sf_dir, "events").select("event_id", date_string(F.col("ts"), "year").alias("y"), date_string(F.col("ts"), "day").alias("d"), date_string(F.col("ts"), "second").alias("s"))


@register("number_strings", "SELECT o_orderkey, o_orderkey AS back, true AS sorted FROM orders")
def number_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions.codecs import long_string, string_long

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", string_long(long_string(k)).alias("back"), ((long_string(-k - 1) < long_string(k)) & (long_string(k) < long_string(k + 1))).alias("sorted"))


@register("highlight_whole", "SELECT p_partkey, regexp_replace(p_name, '\\b(green|blue|red)\\b', '<B>\\1</B>', 'g') AS marked FROM part")
def highlight_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.highlight import highlight_whole

    return table(spark, sf_dir, "part").select("p_partkey", highlight_whole(F.col("p_name"), ["green", "blue", "red"]).alias("marked"))


@register("highlight_fragments")
def highlight_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.highlight import highlight

    q = A.any_of(A.Term("text", "with"), A.Term("text", "from"))
    s = searcher(spark, sf_dir)
    top = s.search(q, 10, columns=("text",))
    return top.select("doc_id", highlight(F.col("text"), q, 2).alias("fragments"))


@register("stored_queries", f"WITH {TOKENS} SELECT 'must' AS query, doc_id FROM t WHERE term IN ('with', 'from') GROUP BY doc_id HAVING count(DISTINCT term) = 2 UNION ALL SELECT DISTINCT 'prefix', doc_id FROM t WHERE starts_with(term, 'zu')")
def stored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.streaming.prospective import match_stored

    stored = {"must": A.all_of(A.Term("text", "with"), A.Term("text", "from")), "prefix": A.Prefix("text", "zu")}
    return match_stored(spread(table(spark, sf_dir, "documents")), DOCS, stored).select("query", "doc_id")


@register("parsed_query", f"WITH {weights({'the': 1, 'with': 2})} SELECT doc_id, round(sum(s) * count(*) / 2, 6) AS score FROM h GROUP BY doc_id HAVING bool_or(term = 'the') AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'from') {topk(10)}")
def parsed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.plans.parser import QueryParser

    return searcher(spark, sf_dir).search(QueryParser("text").parse("+the with^2 -from"), 10)


@register("event_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.streaming.prospective import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


# --- more of index maintenance, filters, fields and codecs ---------------------------------------


@register("index_delete_query", "SELECT p_partkey FROM part WHERE NOT starts_with(p_brand, 'Brand#1')")
def index_delete_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = part_index(spark, sf_dir)
    w.delete_query(A.Prefix("brand", "Brand#1"))
    w.commit()
    return w.reader().docs().select("p_partkey")


@register("index_undelete", "SELECT p_partkey FROM part")
def index_undelete(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = part_index(spark, sf_dir)
    w.delete_query(A.Prefix("brand", "Brand#1"))
    w.undelete_all()
    return w.reader().docs().select("p_partkey")


@register("index_delete_all", "SELECT p_partkey FROM part WHERE p_partkey % 7 = 0")
def index_delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = part_index(spark, sf_dir)
    w.delete_all()
    w.add(table(spark, sf_dir, "part").where("p_partkey % 7 = 0"))
    return w.reader().docs().select("p_partkey")


@register("index_expunge", "SELECT count(*) FILTER (WHERE p_brand NOT LIKE 'Brand#1%') AS num_docs, count(*) FILTER (WHERE p_brand NOT LIKE 'Brand#1%') AS max_doc, count(*) AS before FROM part")
def index_expunge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = part_index(spark, sf_dir)
    w.delete_query(A.Prefix("brand", "Brand#1"))
    before = w.reader().max_doc()
    w.expunge_deletes()
    r = w.reader()
    return spark.createDataFrame([(r.num_docs(), r.max_doc(), before)], "num_docs long, max_doc long, before long")


@register("index_add_indexes", "SELECT p_partkey FROM part UNION ALL SELECT p_partkey + 1000000 FROM part WHERE p_size < 10")
def index_add_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources.index import IndexWriter

    w = part_index(spark, sf_dir)
    other = IndexWriter(spark, scratch(spark), PARTS, create=True)
    other.add(table(spark, sf_dir, "part").where("p_size < 10").withColumn("p_partkey", F.col("p_partkey") + 1000000))
    w.add_indexes(other.reader())
    w.optimize(2)
    return w.reader().docs().select("p_partkey")


SIZED = Schema("p_partkey", {"size": numeric_field("p_size"), "name": FieldSpec("p_name", an.WHITESPACE, payload=lambda t: t["pos"] + 1)})


def sized_index(spark: SparkSession, sf_dir: str):
    from tesserae.sources.index import IndexWriter

    w = IndexWriter(spark, scratch(spark), SIZED, create=True)
    w.add(table(spark, sf_dir, "part"))
    return w.reader()


register("index_numeric_range", "SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE p_size > 7 AND p_size <= 33")(lambda spark, sf_dir: Searcher(sized_index(spark, sf_dir)).hits(A.NumericRange("size", 7, 33, False, True)))
register("scan_numeric_field", "SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE p_size >= 20")(lambda spark, sf_dir: Searcher(ScanView(spread(table(spark, sf_dir, "part")), SIZED)).hits(A.NumericRange("size", 20, None)))


@register("index_payload_spans", f"WITH d AS (SELECT p_partkey, {PART_TERMS} AS ts FROM part), q AS (SELECT min(string_split(p_name, ' ')[1]) AS term FROM part) SELECT p_partkey, sum(i)::DOUBLE AS total FROM d, q, unnest(range(1, len(ts) + 1)) AS u(i) WHERE ts[i] = term GROUP BY p_partkey")
def index_payload_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Searcher(sized_index(spark, sf_dir)).payloads(A.SpanTerm("name", first_term(spark, sf_dir)))
    return found.select("p_partkey", F.aggregate("payloads", F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("multi_index_search", SQL["index_search"])
def multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.sources.index import IndexWriter, MultiIndexView

    readers = []
    for k in range(2):
        w = IndexWriter(spark, scratch(spark), PARTS, create=True)
        w.add(table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == k))
        readers.append(w.reader())
    return Searcher(MultiIndexView(readers)).hits(A.Term("name", first_term(spark, sf_dir)))


@register("stored_fields", f"WITH {TOKENS} SELECT DISTINCT doc_id, d.source, d.n_chars FROM t JOIN documents d USING (doc_id) WHERE term = 'with'")
def stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = searcher(spark, sf_dir)
    return s.documents(s.hits(A.Term("text", "with")).select("doc_id"), table(spark, sf_dir, "documents"), ("source", "n_chars"))


@register("query_vector", "SELECT term, count(*) AS freq FROM (SELECT unnest(['to', 'be', 'or', 'not', 'to', 'be']) AS term) GROUP BY term")
def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.vectors import query_vector as vector

    return vector(spark, "To be, or not to be!", an.SIMPLE)


hits("prefix_filter", A.Term("text", "the"), f"WITH {weights({'the': 1})} SELECT doc_id, round(s, 6) AS score FROM h WHERE doc_id IN (SELECT doc_id FROM p WHERE starts_with(term, 'zu'))", filter=A.Prefix("text", "zu"))
hits("term_range_filter", A.Term("text", "the"), f"WITH {weights({'the': 1})} SELECT doc_id, round(s, 6) AS score FROM h JOIN documents USING (doc_id) WHERE lang >= 'de' AND lang < 'es'", filter=A.TermRange("lang", "de", "es", True, False))
hits("combined_query", A.combined([A.any_of(A.Term("text", "the"), A.Term("text", "with"), disable_coord=True), A.Term("text", "with"), A.Term("text", "from")]), f"WITH {weights({'the': 1, 'with': 1, 'from': 1})} SELECT doc_id, round(sum(s), 6) AS score FROM h GROUP BY doc_id")
hits("prefix_auto", A.Prefix("text", "the", "auto"), f"WITH {TOKENS} {CONST} starts_with(term, 'the')")


@register("cached_filter", f"WITH {weights({'the': 1})} SELECT doc_id, round(s, 6) AS score FROM h WHERE doc_id IN (SELECT doc_id FROM p WHERE term = 'with')")
def cached_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.filters import FilterCache

    s = searcher(spark, sf_dir)
    return s.hits(A.Term("text", "the"), FilterCache(s.view, scratch(spark)).get(A.Term("text", "with")))


@register("set_counts", f"WITH {TOKENS}, a AS (SELECT DISTINCT doc_id FROM t WHERE term = 'with'), b AS (SELECT DISTINCT doc_id FROM t WHERE term = 'from') SELECT count(a.doc_id + b.doc_id) AS both, count(*) AS either, count(a.doc_id) - count(a.doc_id + b.doc_id) AS only_a, count(b.doc_id) - count(a.doc_id + b.doc_id) AS only_b, count(*) - count(a.doc_id + b.doc_id) AS one_of FROM a FULL JOIN b USING (doc_id)")
def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.filters import counts

    return counts(docs_with(spark, sf_dir, "with"), docs_with(spark, sf_dir, "from"))


register("sort_missing", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(quality, 0) DESC, doc_id LIMIT 40")(
    lambda spark, sf_dir: Searcher(ScanView(spread(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")), DOCS)).search(A.MatchAll(), 40, sort=(SortField("int", "quality", reverse=True),)).select("doc_id")
)


@register("numeric_terms", "SELECT o_orderkey, o_orderkey AS back, (o_orderkey // 16) * 16 AS coarse, true AS sorted FROM orders")
def numeric_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions.codecs import prefix_coded, prefix_decoded

    k = F.col("o_orderkey").cast("long")
    ordered = (prefix_coded(-k - 1) < prefix_coded(k)) & (prefix_coded(k) < prefix_coded(k + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", prefix_decoded(prefix_coded(k)).alias("back"), prefix_decoded(prefix_coded(k, 4)).alias("coarse"), ordered.alias("sorted"))


@register("sortable_doubles", "SELECT o_orderkey, (o_totalprice < 150000) AS below FROM orders")
def sortable_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions.codecs import sortable_long

    return table(spark, sf_dir, "orders").select("o_orderkey", (sortable_long(F.col("o_totalprice").cast("double")) < sortable_long(F.lit(150000.0))).alias("below"))


@register("compressed", "SELECT p_partkey, p_name AS back FROM part")
def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.functions.codecs import compress, decompress

    return table(spark, sf_dir, "part").select("p_partkey", F.decode(decompress(compress(F.encode("p_name", "UTF-8"))), "UTF-8").alias("back"))


register("edit_distances", "SELECT p_partkey, levenshtein(p_name, 'green blue') AS d FROM part")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", F.lit("green blue")).cast("long").alias("d")))
token_stats("ngram_filter", an.Analyzer(an.lowercase_letter, (an.ngram_filter(3, 3),)), "list_distinct(list_value()) || flatten(list_transform(list_filter(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: length(x) >= 3), lambda x: list_transform(range(1, length(x) - 1), lambda i: x[i:i+2])))")
token_stats("latin1", an.Analyzer(an.lowercase_letter, (an.latin1_folding,)), "list_transform(regexp_extract_all(lower(text), '\\p{L}+'), lambda x: replace(strip_accents(x), 'ß', 'ss'))")


@register("highlight_field", "SELECT p_partkey, regexp_replace(p_type, '\\b(ECONOMY|SMALL)\\b', '<B>\\1</B>', 'g') AS marked FROM part WHERE regexp_matches(p_type, '\\b(ECONOMY|SMALL)\\b')")
def highlight_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.operators.highlight import TermMarker, highlight_field, whole

    q = A.any_of(A.Term("type", "economy"), A.Term("type", "small"))
    found = highlight_field(F.col("p_type"), an.SIMPLE, TermMarker(q), fragmenter=whole)
    return table(spark, sf_dir, "part").select("p_partkey", F.get(found, 0).alias("marked")).where("marked is not null")
