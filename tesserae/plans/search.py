"""Query trees compiled to one projection over documents.

A *view* gives one row per document with, for each leaf of the query, the
positions of its term in that document, each field's norm, and stored columns.
Over such a row every query is an expression: whether it matches, and its
score.  So a Boolean tree costs no join and no shuffle of its own; only
statistics (one aggregate over all leaves) and the top k cross tasks.

Two views exist.  ``ScanView`` analyzes the document table while it reads it: a
narrow plan from scan to hits.  ``tesserae.sources.index`` reads a written
index, where the leaves' postings are found by pushed-down filters on a sorted
table and meet in one aggregation by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.codecs import prefix_decoded, trie_range
from tesserae.functions.similarity import Similarity
from tesserae.operators import positions as P
from tesserae.plans import ast as A
from tesserae.schema import Schema

DOC = "__doc"
POSITIONS = "array<int>"
HERE = "__here"


@dataclass(frozen=True)
class Leaf:
    """An exact term, or a predicate over terms; ``key`` tells predicates apart."""

    field: str
    term: str | None = None
    key: str = ""
    pred: Callable[[Column], Column] | None = field(default=None, compare=False)
    terms: bool = False  # the terms that pass, instead of their positions


class View(Protocol):
    schema: Schema

    def rows(self, leaves: list[Leaf], norm_fields: set[str], columns: set[str], all_docs: bool, sim: Similarity) -> DataFrame: ...

    def doc_freqs(self, leaves: list[Leaf], sim: Similarity) -> tuple[list[int], int]: ...

    def dictionary(self, field_name: str) -> DataFrame: ...


def slot(i: int) -> str:
    return f"__p{i}"


def payload_slot(i: int) -> str:
    return f"__l{i}"


def _payloads(tokens: Column, payload: Callable[[Column], Column], sim: Similarity) -> Column:
    return F.transform(tokens, lambda t: sim.payload_score(payload(t).cast("double")).cast("double"))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once; a column of its own could be written out again at each use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def in_terms(tokens: Column, entry: Callable[[Column, Column], Column]) -> Column:
    """An entry of (term, its tokens in order) for each distinct term of a token array.

    A document's tokens stand in one row, so they are grouped there, and no row is shuffled.
    """
    none = F.array().cast("array<int>")

    def grouped(s: Column) -> Column:
        term = lambda i: F.element_at(s, i)["term"]
        starts = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.when(i == 1, True).otherwise(term(i) != term(i - 1)))).otherwise(none)

        def one(at: Column) -> Callable[[Column, Column], Column]:
            return lambda i, k: entry(term(i), F.slice(s, i, F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i))

        return bound(starts, lambda at: F.transform(at, one(at)))

    return bound(F.sort_array(tokens), grouped)


def spread(df: DataFrame) -> DataFrame:
    """A table of few files over all cores, so that analysis is not one task; larger tables already have more splits."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() * 2 <= n else df


def norm_name(f: str) -> str:
    return f"__norm_{f}"


def _test(x: Leaf) -> Callable[[Column], Column]:
    """A leaf's test of a token; Spark counts a lambda's parameters, so it has one."""
    return (lambda t: t["term"] == x.term) if x.pred is None else (lambda t: x.pred(t["term"]))


@dataclass
class ScanView:
    """Documents analyzed as they are read."""

    docs: DataFrame
    schema: Schema

    def _stream(self, f: str) -> Column:
        spec = self.schema.fields[f]
        return spec.analyzer.of_values(F.col(spec.column)) if spec.repeated else spec.analyzer(F.col(spec.column))

    def rows(self, leaves: list[Leaf], norm_fields: set[str], columns: set[str], all_docs: bool, sim: Similarity) -> DataFrame:
        fields = sorted({x.field for x in leaves} | norm_fields)
        boost = F.col(self.schema.boost_col) if self.schema.boost_col else F.lit(1.0)
        base = self.docs.select(F.col(self.schema.id_col).alias(DOC), *[self._stream(f).alias(f"__t_{f}") for f in fields], *[F.col(c).alias(f"__c_{c}") for c in sorted(columns)], boost.cast("double").alias("__boost"))
        kept = []
        for i, x in enumerate(leaves):
            found = F.filter(f"__t_{x.field}", _test(x))
            kept.append((F.transform(found, lambda t: t["term"]) if x.terms else F.transform(found, lambda t: t["pos"]).cast(POSITIONS)).alias(slot(i)))
            if (payload := self.schema.fields[x.field].payload) is not None:
                kept.append(_payloads(found, payload, sim).alias(payload_slot(i)))
        norms = [self._norm(f, F.size(f"__t_{f}"), sim).alias(norm_name(f)) for f in sorted(norm_fields)]
        # Catalyst would push a test of the leaves below their projection, and so analyze every text once more per
        # leaf, ahead of any exchange; it pushes nothing below a projection with a nondeterministic column.  Without
        # leaves nothing is analyzed, and a test of stored columns shall reach the scan.
        here = [F.spark_partition_id().alias(HERE)] if leaves else []
        return base.select(DOC, *kept, *norms, *[f"__c_{c}" for c in sorted(columns)], *here)

    def _norm(self, f: str, n: Column, sim: Similarity) -> Column:
        spec = self.schema.fields[f]
        return sim.norm(n, F.col("__boost") * spec.boost) if spec.norms else F.lit(1.0)

    def doc_freqs(self, leaves: list[Leaf], sim: Similarity) -> tuple[list[int], int]:
        rows = self.rows(leaves, set(), set(), False, sim)
        counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.size(slot(i)) > 0).alias(slot(i)) for i in range(len(leaves))]).first()
        return [counts[slot(i)] for i in range(len(leaves))], counts["n"]

    def tokens(self, f: str) -> Column:
        """A field's stream as (term, pos) only."""
        return F.transform(self._stream(f), lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos")))

    def postings(self, f: str) -> DataFrame:
        """(term, doc, tf, positions) of a field: a narrow plan."""
        tokens = self.tokens(f)
        entry = lambda term, own: F.struct(term.alias("term"), F.size(own).cast("long").alias("tf"), F.transform(own, lambda t: t["pos"]).alias("positions"))
        return self.docs.select(F.col(self.schema.id_col).alias(DOC), F.explode(in_terms(tokens, entry)).alias("e")).select("e.term", DOC, "e.tf", "e.positions")

    def dictionary(self, f: str) -> DataFrame:
        """(term, df, cf) of a field; a row's first occurrence of each term is marked, so one aggregation counts both."""
        def marked(ts: Column) -> Column:
            return F.transform(ts, lambda t, i: F.struct(t.alias("term"), F.when(i == 0, True).otherwise(F.get(ts, i - 1) != t).cast("long").alias("first")))

        tokens = self.docs.select(F.explode(bound(F.sort_array(F.transform(self._stream(f), lambda t: t["term"])), marked)).alias("x"))
        return tokens.groupBy(F.col("x.term").alias("term")).agg(F.sum("x.first").alias("df"), F.count("*").alias("cf"))


# --- multi-term expansion ----------------------------------------------------------------------


def like_regex(pattern: str) -> str:
    """A wildcard pattern as an anchored regular expression."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in pattern) + "$"


def term_predicate(q: A.MultiTerm) -> Callable[[Column], Column]:
    """The set of terms of a constant-score query, as a test of one term."""
    if isinstance(q, A.Prefix):
        return lambda t: F.startswith(t, F.lit(q.prefix))
    if isinstance(q, A.Wildcard):
        literal = q.pattern[: min((q.pattern.find(c) for c in "*?" if c in q.pattern), default=len(q.pattern))]
        return lambda t: F.startswith(t, F.lit(literal)) & t.rlike(like_regex(q.pattern)) if literal else t.rlike(like_regex(q.pattern))
    if isinstance(q, A.TermRange):
        side = (lambda x: F.collate(x, q.collation)) if q.collation else (lambda x: x)

        def test(t: Column) -> Column:
            ok = F.lit(True)
            if q.low is not None:
                ok = ok & ((side(t) >= side(F.lit(q.low))) if q.include_low else (side(t) > side(F.lit(q.low))))
            if q.high is not None:
                ok = ok & ((side(t) <= side(F.lit(q.high))) if q.include_high else (side(t) < side(F.lit(q.high))))
            return ok

        return test
    raise TypeError(q)


def fuzzy_matches(view: View, q: A.Fuzzy) -> list[tuple[str, float, int]]:
    """(term, similarity, document frequency) of the dictionary's best matches, at most as many as a Boolean query holds.

    similarity = 1 - distance / (prefix + shorter rest); the rests' edit
    distance is bounded, so longer or shorter terms are pruned by length.
    """
    prefix, rest = q.term[: q.prefix_length], q.term[q.prefix_length :]
    n, p = len(rest), len(prefix)
    t = view.dictionary(q.field).select("term", "df")
    other = F.substring("term", p + 1, 1 << 30)
    shorter = F.least(F.length(other), F.lit(n))
    most = F.floor((1 - q.min_similarity) * (shorter + p)).cast("int")
    t = t.where(F.startswith("term", F.lit(prefix))).withColumns({"other": other, "base": shorter + p, "most": most})
    t = t.where(F.abs(F.length("other") - n) <= F.col("most")).withColumn("d", F.levenshtein("other", F.lit(rest)))
    # one side empty: nothing to compare by
    t = t.withColumn("sim", F.when(F.col("base") > 0, 1 - F.col("d") / F.col("base")).otherwise(F.when(F.col("d") == 0, 1.0).otherwise(0.0)))
    best = t.where(F.col("sim") > q.min_similarity).orderBy(F.desc("sim"), "term").limit(A.MAX_CLAUSES)
    return [(r["term"], r["sim"], r["df"]) for r in best.select("term", "sim", "df").collect()]


#: An automatic rewrite looks terms up one by one up to so many, and up to this share of the documents.
AUTO_TERMS, AUTO_SHARE = 350, 0.001


def expand(q: Any, view: View) -> Any:
    """The tree with fuzzy and scoring multi-term queries replaced by weighted terms of the dictionary."""
    from dataclasses import replace

    if isinstance(q, A.Boolean):
        return replace(q, clauses=tuple(A.Clause(c.occur, expand(c.query, view)) for c in q.clauses))
    if isinstance(q, A.DisMax):
        return replace(q, disjuncts=tuple(expand(d, view) for d in q.disjuncts))
    if isinstance(q, (A.Filtered, A.CustomScore)):
        return replace(q, query=expand(q.query, view))
    if isinstance(q, A.ConstantScore) and isinstance(q.filter, A.Query):
        return replace(q, filter=expand(q.filter, view))
    if isinstance(q, A.Fuzzy):
        # a term no other can resemble enough is looked up as it is, without its boost
        if len(q.term) <= 1 / (1 - q.min_similarity):
            return A.Term(q.field, q.term)
        scale = 1 / (1 - q.min_similarity)
        found = fuzzy_matches(view, q)
        return A.TermSet(q.field, tuple((t, q.boost * (s - q.min_similarity) * scale) for t, s, _ in found), dfs=tuple(n for _, _, n in found))
    if isinstance(q, A.MultiTerm) and q.rewrite == "scoring":
        test = term_predicate(q)
        found = view.dictionary(q.field).where(test(F.col("term"))).select("term", "df").orderBy("term").limit(A.MAX_CLAUSES + 1).collect()
        if len(found) > A.MAX_CLAUSES:
            raise A.TooManyClauses(f"{q} matches more than {A.MAX_CLAUSES} terms")
        return A.TermSet(q.field, tuple((r["term"], q.boost) for r in found), dfs=tuple(r["df"] for r in found))
    if isinstance(q, A.MultiTerm) and q.rewrite == "auto":
        # few terms and few documents are looked up one by one, which an index does by its sorted files; else a filter
        test = term_predicate(q)
        found = view.dictionary(q.field).where(test(F.col("term"))).select("term", "df").limit(AUTO_TERMS + 1).collect()
        if len(found) <= AUTO_TERMS and sum(r["df"] for r in found) <= AUTO_SHARE * view.doc_freqs([], Similarity())[1]:
            own = sorted(r["term"] for r in found)
            return A.ConstantScore(A.TermSet(q.field, tuple((t, 1.0) for t in own), dfs=(0,) * len(own)), q.boost)
        return replace(q, rewrite="constant")
    if isinstance(q, A.MultiTerm) and q.rewrite == "filter":
        return replace(q, rewrite="constant")
    return q


# --- compilation -------------------------------------------------------------------------------


@dataclass
class Hit:
    """Whether a row matches, and the score where it does."""

    match: Column
    score: Column


@dataclass(frozen=True)
class DocSet:
    """A filter given as a frame of document ids (column ``doc_id`` or the only one)."""

    name: str
    frame: DataFrame = field(compare=False)


class Compiler:
    """Binds a query to a view: leaves, statistics, weights, then expressions."""

    def __init__(self, view: View, query: A.Query, sim: Similarity | None = None, *more: A.Query):
        """``more`` queries share the rows, and so the analysis, of the first; ``self.queries`` holds all."""
        self.view, self.sim = view, sim or Similarity()
        self.queries = [expand(A.simplify(q), view) for q in (query, *more)]
        self.query = self.queries[0]
        self.leaves: dict[Leaf, int] = {}
        self.norm_fields: set[str] = set()
        self.columns: set[str] = set()
        self.doc_sets: dict[DocSet, str] = {}
        self.all_docs = False
        self.steps: list[tuple[str, Column]] = []
        self.set_df: dict[tuple[str, str], int] = {}
        for q in self.queries:
            self._gather(q)
        # a term's weight needs its document frequency; predicates have a constant score
        self.counted = [x for x in self.leaves if x.pred is None]
        df, self.max_doc = view.doc_freqs(self.counted, self.sim)
        self.df = dict(zip(self.counted, df))

    # leaves
    def _leaf(self, x: Leaf) -> None:
        self.leaves.setdefault(x, len(self.leaves))

    def _norm(self, f: str) -> None:
        self.norm_fields.add(f)

    def _trie(self, q: A.NumericRange) -> int | None:
        """The step of a numeric field's terms, where the range is one over them."""
        spec = self.view.schema.fields.get(q.field)
        return spec.trie_step if spec else None

    def _gather(self, q: Any) -> None:
        if isinstance(q, A.Term):
            self._leaf(Leaf(q.field, q.term))
            self._norm(q.field)
        elif isinstance(q, A.Phrase):
            for slot_terms in q.slots:
                for t in slot_terms:
                    self._leaf(Leaf(q.field, t))
            self._norm(q.field)
        elif isinstance(q, A.Span):
            for f, t in self._span_leaves(q):
                self._leaf(Leaf(f, t))
            self._norm(self.span_field(q))
        elif isinstance(q, A.TermSet):
            self._leaf(self._set(q))
            self._norm(q.field)
            own = [w for w, _ in q.weights]
            if q.dfs is not None:
                self.set_df |= {(q.field, t): n for t, n in zip(own, q.dfs)}
                return
            rows = self.view.dictionary(q.field).where(F.col("term").isin(own)).select("term", "df").collect() if own else []  # at most MAX_CLAUSES
            self.set_df |= {(q.field, r["term"]): r["df"] for r in rows}
        elif isinstance(q, A.MultiTerm):
            self._leaf(self._predicate(q))
        elif isinstance(q, A.Boolean):
            for c in q.clauses:
                self._gather(c.query)
        elif isinstance(q, A.DisMax):
            for d in q.disjuncts:
                self._gather(d)
        elif isinstance(q, A.NumericRange) and self._trie(q):
            self._leaf(trie_leaf(q, self._trie(q)))
        elif isinstance(q, A.NumericRange):
            self.columns.add(q.field)
            self.all_docs = True
        elif isinstance(q, A.MatchAll):
            self.all_docs = True
            if q.norms_field:
                self._norm(q.norms_field)
        elif isinstance(q, A.ConstantScore):
            self._filter(q.filter)
        elif isinstance(q, A.Filtered):
            self._gather(q.query)
            self._filter(q.filter)
        elif isinstance(q, A.FieldScore):
            self.all_docs = True
            self.columns.add(q.source.column)
        elif isinstance(q, A.CustomScore):
            self._gather(q.query)
            for s in q.sources:
                self.columns.add(s.source.column)
        else:
            raise TypeError(f"not a query: {q!r}")

    def _filter(self, f: Any) -> None:
        if isinstance(f, A.Query):
            self._gather(f)
        elif isinstance(f, DocSet):
            self.doc_sets.setdefault(f, f"__s{len(self.doc_sets)}")
            self.all_docs = True
        elif isinstance(f, ColumnFilter):
            self.columns |= set(f.columns)
            self.all_docs = True
        else:
            raise TypeError(f"not a filter: {f!r}")

    @staticmethod
    def _predicate(q: A.MultiTerm) -> Leaf:
        from dataclasses import replace

        return Leaf(q.field, None, str(replace(q, boost=1.0)) + str(getattr(q, "collation", "")), term_predicate(q))

    @staticmethod
    def _set(q: A.TermSet) -> Leaf:
        own = [t for t, _ in q.weights]
        return Leaf(q.field, None, "set " + " ".join(own), lambda t: t.isin(own) if own else F.lit(False), True)

    def _span_leaves(self, q: A.Span) -> list[tuple[str, str]]:
        if isinstance(q, A.SpanTerm):
            return [(q.field, q.term)]
        if isinstance(q, A.SpanNot):
            return self._span_leaves(q.include) + self._span_leaves(q.exclude)
        if isinstance(q, A.SpanFirst):
            return self._span_leaves(q.match)
        if isinstance(q, (A.FieldMask, A.Payload)):
            return self._span_leaves(q.query)
        return [t for c in q.clauses for t in self._span_leaves(c)]

    def span_field(self, q: A.Span) -> str:
        if isinstance(q, (A.SpanTerm, A.FieldMask)):
            return q.field
        if isinstance(q, A.SpanNot):
            return self.span_field(q.include)
        if isinstance(q, A.SpanFirst):
            return self.span_field(q.match)
        if isinstance(q, A.Payload):
            return self.span_field(q.query)
        fields = {self.span_field(c) for c in q.clauses}
        if len(fields) != 1:
            raise ValueError("the clauses of a span query must have one field")
        return fields.pop()

    # statistics and weights
    def idf(self, q: Any) -> float:
        if isinstance(q, A.Term):
            return self.sim.idf(self.df[Leaf(q.field, q.term)], self.max_doc)
        if isinstance(q, A.Phrase):
            return sum(self.sim.idf(self.df[Leaf(q.field, t)], self.max_doc) for s in q.slots for t in s)
        return sum(self.sim.idf(self.df[Leaf(f, t)], self.max_doc) for f, t in A.span_terms(q))

    def set_idf(self, f: str, t: str) -> float:
        return self.sim.idf(self.set_df.get((f, t), 0), self.max_doc)

    def squares(self, q: Any) -> float:
        """The sum of squared weights of a tree."""
        if isinstance(q, (A.Term, A.Phrase)) or isinstance(q, A.Span):
            return (self.idf(q) * q.boost) ** 2
        if isinstance(q, A.TermSet):
            return sum((b * self.set_idf(q.field, t)) ** 2 for t, b in q.weights) * q.boost**2
        if isinstance(q, A.Boolean):
            return sum(self.squares(c.query) for c in q.clauses if c.occur != A.MUST_NOT) * q.boost**2
        if isinstance(q, A.DisMax):
            parts = [self.squares(d) for d in q.disjuncts]
            most = max(parts, default=0.0)
            return ((sum(parts) - most) * q.tie**2 + most) * q.boost**2
        if isinstance(q, A.Filtered):
            return self.squares(q.query) * q.boost**2
        if isinstance(q, A.CustomScore):
            own = 0.0 if q.strict else sum(s.boost**2 for s in q.sources)
            return (self.squares(q.query) + own) * q.boost**2
        return q.boost**2

    # expressions
    def positions(self, f: str, t: str) -> Column:
        return F.col(slot(self.leaves[Leaf(f, t)]))

    def hit(self, q: Any, norm: float) -> Hit:
        """The expressions of a tree under a normalisation factor."""
        if isinstance(q, A.Term):
            idf = self.idf(q)
            p = self.positions(q.field, q.term)
            freq = F.size(p).cast("double") if self.view.schema.fields[q.field].freqs else F.lit(1.0)
            return Hit(F.size(p) > 0, self.sim.tf(freq) * F.lit(norm * q.boost * idf * idf) * self.norm_of(q.field))
        if isinstance(q, A.Phrase):
            if not q.slots or not self.view.schema.fields[q.field].freqs:
                return Hit(F.lit(False), F.lit(0.0))
            slots = [self._slot(q.field, s) for s in q.slots]
            freq = P.sloppy_freq(slots, q.positions, q.slop, [frozenset(s) for s in q.slots]) if q.slop else P.exact_freq(slots, q.positions)
            idf = self.idf(q)
            return Hit(freq > 0, self.sim.tf(freq) * F.lit(norm * q.boost * idf * idf) * self.norm_of(q.field))
        if isinstance(q, A.Payload):
            inner = self.hit(q.query.boosted(q.query.boost * q.boost), norm)
            own = self.payload_score(q)
            return Hit(inner.match, inner.score * own if q.include_span_score else own)
        if isinstance(q, A.Span):
            spans = self._held(self.spans(q))
            idf = self.idf(q)
            freq = F.aggregate(spans, F.lit(0.0), lambda a, s: a + self.sim.sloppy_freq((s["e"] - s["s"]).cast("double")))
            return Hit(F.size(spans) > 0, self.sim.tf(freq) * F.lit(norm * q.boost * idf * idf) * self.norm_of(self.span_field(q)))
        if isinstance(q, A.TermSet):
            m = F.col(slot(self.leaves[self._set(q)]))
            if not q.weights:
                return Hit(F.lit(False), F.lit(0.0))
            values = F.create_map(*[F.lit(x) for t, b in q.weights for x in (t, norm * q.boost * b * self.set_idf(q.field, t) ** 2)])
            score = F.aggregate(F.array_distinct(m), F.lit(0.0), lambda a, t: a + self.sim.tf(F.size(F.filter(m, lambda x: x == t)).cast("double")) * F.element_at(values, t))
            return Hit(F.size(m) > 0, score * self.norm_of(q.field))
        if isinstance(q, A.MultiTerm):
            return Hit(F.size(slot(self.leaves[self._predicate(q)])) > 0, F.lit(norm * q.boost))
        if isinstance(q, A.NumericRange) and self._trie(q):
            return Hit(F.size(slot(self.leaves[trie_leaf(q, self._trie(q))])) > 0, F.lit(norm * q.boost))
        if isinstance(q, A.NumericRange):
            return Hit(numeric_test(F.col(f"__c_{q.field}"), q), F.lit(norm * q.boost))
        if isinstance(q, A.MatchAll):
            score = F.lit(norm * q.boost)
            return Hit(F.lit(True), score * self.norm_of(q.norms_field) if q.norms_field else score)
        if isinstance(q, A.ConstantScore):
            return Hit(self.test(q.filter), F.lit(norm * q.boost))
        if isinstance(q, A.Filtered):
            h = self.hit(q.query, norm)
            return Hit(h.match & self.test(q.filter), h.score * F.lit(q.boost))
        if isinstance(q, A.FieldScore):
            return Hit(F.lit(True), F.lit(norm * q.boost) * self.value(q.source))
        if isinstance(q, A.CustomScore):
            h = self.hit(q.query, norm * q.boost)
            values = [self.value(s.source) * F.lit(s.boost * (1.0 if q.strict else norm * q.boost)) for s in q.sources]
            fn = q.fn or (lambda s, *vs: reduce(lambda a, b: a * b, vs, s))
            return Hit(h.match, F.lit(q.boost) * fn(h.score, *values))
        if isinstance(q, A.DisMax):
            hits = [self.hit(d, norm * q.boost) for d in q.disjuncts]
            if not hits:
                return Hit(F.lit(False), F.lit(0.0))
            scores = [F.when(h.match, h.score) for h in hits]
            most = F.greatest(*scores) if len(scores) > 1 else scores[0]
            total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores])
            return Hit(reduce(lambda a, b: a | b, [h.match for h in hits]), most + (total - most) * q.tie)
        if isinstance(q, A.Boolean):
            return self._boolean(q, norm)
        raise TypeError(q)

    def _boolean(self, q: A.Boolean, norm: float) -> Hit:
        own = [(c.occur, self.hit(c.query, norm * q.boost)) for c in q.clauses]
        must = [h for o, h in own if o == A.MUST]
        should = [h for o, h in own if o == A.SHOULD]
        least = max(q.min_should, 0 if must else 1)
        if not must and not should or least > len(should):
            return Hit(F.lit(False), F.lit(0.0))
        ok = F.lit(True)
        for h in must:
            ok = ok & h.match
        for o, h in own:
            if o == A.MUST_NOT:
                ok = ok & ~h.match
        n_should = reduce(lambda a, b: a + b, [h.match.cast("int") for h in should], F.lit(0))
        if least:
            ok = ok & (reduce(lambda a, b: a | b, [h.match for h in should]) if least == 1 else n_should >= least)
        score = reduce(lambda a, b: a + b, [h.score for h in must] + [F.when(h.match, h.score).otherwise(0.0) for h in should])
        if not q.disable_coord:
            most = sum(o != A.MUST_NOT and self.scored(c.query) for (o, _), c in zip(own, q.clauses))
            if most:
                score = score * self.sim.coord(n_should + len(must), most)
        return Hit(ok, score)

    def scored(self, q: Any) -> bool:
        """Whether a clause has anything that could score, and so counts in the coordination factor."""
        if isinstance(q, A.Boolean):
            return any(c.occur != A.MUST_NOT and self.scored(c.query) for c in q.clauses)
        if isinstance(q, A.Phrase):
            return bool(q.slots)
        return True

    def norm_of(self, f: str) -> Column:
        return F.col(norm_name(f))

    def _slot(self, f: str, terms: Iterable[str]) -> Column:
        arrays = [self.positions(f, t) for t in terms]
        return arrays[0] if len(arrays) == 1 else F.array_sort(F.array_distinct(F.concat(*arrays)))

    def value(self, s: A.ValueSource) -> Column:
        """A document's value; a missing number is 0, and a missing string's place is 0."""
        c = F.col(f"__c_{s.column}")
        if s.kind == "value":
            return F.coalesce(c.try_cast(s.cast).cast("double"), F.lit(0.0))
        return F.coalesce(F.col(f"__{s.kind}_{s.column}"), F.lit(0)).cast("double")

    def test(self, f: Any) -> Column:
        if isinstance(f, A.Query):
            return self.hit(f, 1.0).match
        if isinstance(f, DocSet):
            return F.coalesce(F.col(self.doc_sets[f]), F.lit(False))
        return F.coalesce(f.test(*[F.col(f"__c_{c}") for c in f.columns]), F.lit(False))

    def spans(self, q: A.Span) -> Column:
        if isinstance(q, A.SpanTerm):
            return F.transform(self.positions(q.field, q.term), lambda p: F.struct(p.alias("s"), (p + 1).alias("e")))
        if isinstance(q, A.SpanOr):
            return F.array_sort(F.concat(*[self.spans(c) for c in q.clauses]))
        if isinstance(q, A.SpanNot):
            return P.outside(self._held(self.spans(q.include)), self._held(self.spans(q.exclude)))
        if isinstance(q, A.SpanFirst):
            return F.filter(self._held(self.spans(q.match)), lambda x: x["e"] <= q.end)
        if isinstance(q, (A.FieldMask, A.Payload)):
            return self.spans(q.query)
        if len(q.clauses) == 1:
            return self.spans(q.clauses[0])
        return P.near(q.slop, q.in_order)(*[self.spans(c) for c in q.clauses])

    def payload_values(self, q: A.Span) -> tuple[Column, Column]:
        """The payloads under a query's spans, and the spans."""
        spans = self._held(self.spans(q))
        parts = [F.array().cast("array<double>")]
        for f, t in dict.fromkeys(self._span_leaves(q)):
            i = self.leaves[Leaf(f, t)]
            if self.view.schema.fields[f].payload is not None:
                under = F.filter(F.arrays_zip(F.col(slot(i)).alias("p"), F.col(payload_slot(i)).alias("v")), lambda x: F.exists(spans, lambda s: (s["s"] <= x["p"]) & (x["p"] < s["e"])))
                parts.append(F.transform(under, lambda x: x["v"]))
        return F.concat(*parts), spans

    def payload_score(self, q: A.Payload) -> Column:
        """avg, min or max of the payloads under a query's spans; 1 without any."""
        values, _ = self.payload_values(q.query)
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        found = {"avg": total / F.size(values), "min": F.array_min(values), "max": F.array_max(values)}[q.fn]
        return F.when(F.size(values) > 0, found).otherwise(F.lit(1.0))

    def _held(self, c: Column) -> Column:
        """The expression as a column of its own, computed before what reads it (a Python step cannot stand in a lambda)."""
        name = f"__x{len(self.steps)}"
        self.steps.append((name, c))
        return F.col(name)

    # frames
    def frame(self, extra: set[str] | None = None) -> DataFrame:
        """All rows the query may match, with leaves, norms, columns, set flags and held steps; call it after ``hit``."""
        leaves = list(self.leaves)
        rows = self.view.rows(leaves, self.norm_fields, self.columns | (extra or set()), self.all_docs or not leaves, self.sim)
        for s, name in self.doc_sets.items():
            ids = s.frame.select(F.col(s.frame.columns[0]).alias("__id")).distinct().withColumn(name, F.lit(True))
            rows = rows.join(ids, F.col(DOC) == F.col("__id"), "left").drop("__id")
        for source in dict.fromkeys(s for q in self.queries for s in self._sources(q)):
            if source.kind != "value":
                rows = with_ordinals(rows, source)
        for name, c in self.steps:
            rows = rows.withColumn(name, c)
        return rows

    def _sources(self, q: Any) -> list[A.ValueSource]:
        if isinstance(q, A.FieldScore):
            return [q.source]
        if isinstance(q, A.CustomScore):
            return [s.source for s in q.sources] + self._sources(q.query)
        if isinstance(q, A.Boolean):
            return [s for c in q.clauses for s in self._sources(c.query)]
        if isinstance(q, (A.Filtered,)):
            return self._sources(q.query)
        return []

    def hits(self, extra: set[str] | None = None) -> DataFrame:
        """(doc_id, score, extra columns) of all matching documents."""
        qn = self.sim.query_norm(self.squares(self.query))
        h = self.hit(self.query, qn)
        out = matching(self.frame(extra), h.match).select(F.col(DOC).alias(self.view.schema.id_col), h.score.cast("double").alias("score"), *[F.col(f"__c_{c}").alias(c) for c in sorted(extra or ())])
        return out


def trie_leaf(q: A.NumericRange, step: int) -> Leaf:
    """Terms of the precisions that make up a range of whole numbers: runs of sorted terms, of any precision, a few dozen at most."""
    from math import ceil, floor

    low = None if q.low is None else (ceil(q.low) if q.include_low else floor(q.low) + 1)
    high = None if q.high is None else (floor(q.high) if q.include_high else ceil(q.high) - 1)
    runs = trie_range(low, high, step)
    test = lambda t: reduce(lambda a, b: a | b, [t.between(F.lit(x), F.lit(y)) for x, y in runs], F.lit(False))
    return Leaf(q.field, None, f"numbers {low} {high}", test)


def matching(rows: DataFrame, match: Column) -> DataFrame:
    return rows.where(match & (F.col(HERE) >= 0)) if HERE in rows.columns else rows.where(match)


@dataclass(frozen=True)
class ColumnFilter:
    """A predicate over stored columns; null is no match."""

    name: str
    columns: tuple[str, ...]
    test: Callable[..., Column] = field(compare=False)

    def __str__(self) -> str:
        return self.name


def numeric_test(c: Column, q: A.NumericRange) -> Column:
    ok = c.isNotNull()
    if q.low is not None:
        ok = ok & ((c >= F.lit(q.low)) if q.include_low else (c > F.lit(q.low)))
    if q.high is not None:
        ok = ok & ((c <= F.lit(q.high)) if q.include_high else (c < F.lit(q.high)))
    return ok


def with_ordinals(rows: DataFrame, s: A.ValueSource) -> DataFrame:
    """Adds a document's place among the sorted distinct values, from 1, or from the end.

    Values are ranked once each: ranges of them are numbered, and the ranges'
    sizes summed, so no task sees all values.
    """
    c = f"__c_{s.column}"
    values = rows.select(F.col(c).cast("string").alias("__v")).where("__v is not null").distinct()
    ranked = numbered(values, "__v", "__n")
    if s.kind == "rord":
        ranked = ranked.select("__v", (F.lit(values.count()) + 1 - F.col("__n")).alias("__n"))
    joined = rows.join(ranked, F.col(c).cast("string") == F.col("__v"), "left")
    return joined.withColumn(f"__{s.kind}_{s.column}", F.col("__n")).drop("__v", "__n")


def numbered(values: DataFrame, by: str, name: str) -> DataFrame:
    """Distinct values with their places in order, from 1: ranges, places within, and a prefix sum over ranges."""
    from pyspark.sql import Window

    spark = values.sparkSession
    ranged = values.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by).withColumn("__part", F.spark_partition_id())
    within = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(by)))
    sizes = within.groupBy("__part").agg(F.count("*").alias("__size"))
    base = sizes.withColumn("__base", F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))  # a row per range
    return within.join(F.broadcast(base), "__part").withColumn(name, F.col("__k") + F.coalesce("__base", F.lit(0))).drop("__part", "__k", "__size", "__base")


# --- searching ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class SortField:
    """A sort key: score, doc, or a column of a type; missing numbers are 0 and missing strings come first."""

    kind: str
    column: str | None = None
    reverse: bool = False
    collation: str | None = None
    expression: Callable[[Column], Column] | None = field(default=None, compare=False)

    def order(self, id_col: str) -> Column:
        if self.kind == "score":
            return F.col("score").asc() if self.reverse else F.col("score").desc()
        if self.kind == "doc":
            return F.col(id_col).desc() if self.reverse else F.col(id_col).asc()
        c = F.col(self.column)
        if self.expression is not None:
            c = self.expression(c)
        elif self.kind in ("string", "string_val"):
            c = c.cast("string")
            c = F.collate(c, self.collation) if self.collation else c
        else:
            # plain numbers first, then prefix-coded ones
            c = F.coalesce(F.col(self.column).try_cast(NUMBER[self.kind]), prefix_decoded(F.col(self.column).cast("string")).try_cast(NUMBER[self.kind]), F.lit(0))
        return c.desc_nulls_last() if self.reverse else c.asc_nulls_first()


NUMBER = {"byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double"}
SCORE, DOC_ORDER = SortField("score"), SortField("doc")


@dataclass
class Searcher:
    """Ranked retrieval over a view."""

    view: View
    sim: Similarity = field(default_factory=Similarity)
    digits: int = 6

    def hits(self, query: A.Query, filter: Any = None, columns: Iterable[str] = (), positive: bool = False) -> DataFrame:
        """All hits, unranked: (doc_id, score, columns), scores rounded so that ties are ties on any cluster; ``positive`` leaves out scores of 0 and less."""
        q = A.Filtered(query, filter) if filter is not None else query
        found = Compiler(self.view, q, self.sim).hits(set(columns)).withColumn("score", F.round("score", self.digits))
        return found.where("score > 0") if positive else found

    def search(self, query: A.Query, n: int, filter: Any = None, sort: Iterable[SortField] = (SCORE,), offset: int = 0, columns: Iterable[str] = ()) -> DataFrame:
        """The best n hits; ties go to the smaller id."""
        if n <= 0:
            raise ValueError("n must be positive")
        sort = tuple(sort)
        needed = {s.column for s in sort if s.column} | set(columns)
        id_col = self.view.schema.id_col
        ranked = self.hits(query, filter, needed).orderBy(*[s.order(id_col) for s in sort], F.col(id_col).asc())
        ranked = ranked.offset(offset) if offset else ranked
        return ranked.limit(n).select(id_col, "score", *columns)

    def payloads(self, query: A.Span) -> DataFrame:
        """(doc_id, payloads array<double>): the payloads under a span query's spans, of each document that has any span."""
        c = Compiler(self.view, query, self.sim)
        c.hit(c.query, 1.0)
        values, spans = c.payload_values(c.query)
        return matching(c.frame(), F.size(spans) > 0).select(F.col(DOC).alias(self.view.schema.id_col), values.alias("payloads"))

    def totals(self, query: A.Query, filter: Any = None) -> DataFrame:
        """One row: total_hits and max_score."""
        return self.hits(query, filter).agg(F.count("*").alias("total_hits"), F.max("score").alias("max_score"))

    def documents(self, hits: DataFrame, docs: DataFrame, columns: Iterable[str]) -> DataFrame:
        """Stored columns of hits."""
        id_col = self.view.schema.id_col
        return hits.join(docs.select(id_col, *columns), id_col)

    def explain(self, query: A.Query, filter: Any = None) -> DataFrame:
        """(doc_id, score, leaf factors): for each hit the frequency, weight and norm of each exact term."""
        c = Compiler(self.view, A.Filtered(query, filter) if filter is not None else query, self.sim)
        qn = c.sim.query_norm(c.squares(c.query))
        h = c.hit(c.query, qn)
        parts = [F.struct(F.lit(x.field).alias("field"), F.lit(x.term).alias("term"), F.size(slot(i)).alias("freq"), F.lit(c.sim.idf(c.df[x], c.max_doc)).alias("idf"), F.col(norm_name(x.field)).alias("field_norm"), F.lit(qn).alias("query_norm")) for x, i in c.leaves.items() if x.pred is None and x.field in c.norm_fields]
        factors = F.filter(F.array(*parts), lambda p: p["freq"] > 0) if parts else F.array()
        return matching(c.frame(), h.match).select(F.col(DOC).alias(self.view.schema.id_col), F.round(h.score, self.digits).alias("score"), factors.alias("factors"))
