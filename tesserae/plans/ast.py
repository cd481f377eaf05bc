"""Queries as immutable trees.  ``str(query)`` is the canonical form that the parser tests compare."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column

MUST, SHOULD, MUST_NOT = "MUST", "SHOULD", "MUST_NOT"
SIGN = {MUST: "+", SHOULD: "", MUST_NOT: "-"}
MAX_CLAUSES = 1024


class TooManyClauses(ValueError):
    pass


def _boost(b: float) -> str:
    return "" if b == 1.0 else f"^{b}"


@dataclass(frozen=True)
class Query:
    def text(self, default: str = "") -> str:
        raise NotImplementedError

    def __str__(self) -> str:
        return self.text()

    def boosted(self, b: float) -> Query:
        return replace(self, boost=b)


def named(field_name: str, default: str) -> str:
    return "" if field_name == default else f"{field_name}:"


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"{named(self.field, default)}{self.term}{_boost(self.boost)}"


@dataclass(frozen=True)
class Clause:
    occur: str
    query: Query


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[Clause, ...] = ()
    min_should: int = 0
    disable_coord: bool = False
    boost: float = 1.0

    def __post_init__(self) -> None:
        if len(self.clauses) > MAX_CLAUSES:
            raise TooManyClauses(f"more than {MAX_CLAUSES} clauses")

    def add(self, query: Query, occur: str) -> Boolean:
        return replace(self, clauses=(*self.clauses, Clause(occur, query)))

    def text(self, default: str = "") -> str:
        wrap = self.boost != 1.0 or self.min_should > 0
        parts = []
        for c in self.clauses:
            inner = c.query.text(default)
            parts.append(SIGN[c.occur] + (f"({inner})" if isinstance(c.query, Boolean) else inner))
        body = " ".join(parts)
        out = f"({body})" if wrap else body
        return out + (f"~{self.min_should}" if self.min_should > 0 else "") + _boost(self.boost)


def any_of(*queries: Query, **kw: Any) -> Boolean:
    return Boolean(tuple(Clause(SHOULD, q) for q in queries), **kw)


def all_of(*queries: Query, **kw: Any) -> Boolean:
    return Boolean(tuple(Clause(MUST, q) for q in queries), **kw)


def combined(queries: list[Query]) -> Query:
    """One query that matches what any of these does: clauses of plain disjunctions are taken apart, repeats count once."""
    parts: dict[Query, None] = {}
    for q in queries:
        plain = isinstance(q, Boolean) and q.disable_coord and not q.min_should and q.boost == 1.0 and all(c.occur == SHOULD for c in q.clauses)
        parts |= dict.fromkeys(c.query for c in q.clauses) if plain else {q: None}
    return next(iter(parts)) if len(parts) == 1 else any_of(*parts, disable_coord=True)


def merged(queries: list[Boolean]) -> Boolean:
    """The distinct clauses of several Boolean queries in one; the first tells whether it is coordinated."""
    clauses = dict.fromkeys(c for q in queries for c in q.clauses)
    return Boolean(tuple(clauses), disable_coord=bool(queries) and queries[0].disable_coord)


@dataclass(frozen=True)
class DisMax(Query):
    disjuncts: tuple[Query, ...]
    tie: float = 0.0
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        parts = [f"({q.text(default)})" if isinstance(q, Boolean) else q.text(default) for q in self.disjuncts]
        return "(" + " | ".join(parts) + ")" + (f"~{self.tie}" if self.tie else "") + _boost(self.boost)


@dataclass(frozen=True)
class Phrase(Query):
    """Slots of one or more terms at positions; slop 0 is exact."""

    field: str
    slots: tuple[tuple[str, ...], ...]
    positions: tuple[int, ...] = ()
    slop: int = 0
    boost: float = 1.0

    def __post_init__(self) -> None:
        if not self.positions:
            object.__setattr__(self, "positions", tuple(range(len(self.slots))))

    def text(self, default: str = "") -> str:
        at: dict[int, str] = {}
        for slot, p in zip(self.slots, self.positions):
            own = slot[0] if len(slot) == 1 else "(" + " ".join(slot) + ")"
            at[p] = f"{at[p]}|{own}" if p in at else own
        body = " ".join(at.get(p, "?") for p in range(max(at) + 1)) if at else ""
        return f'{named(self.field, default)}"{body}"' + (f"~{self.slop}" if self.slop else "") + _boost(self.boost)


def phrase(field_name: str, *terms: str, **kw: Any) -> Phrase:
    return Phrase(field_name, tuple((t,) for t in terms), **kw)


@dataclass(frozen=True)
class MultiTerm(Query):
    """Base of queries that match every document with some term of a set; ``rewrite`` is constant or scoring."""

    field: str


@dataclass(frozen=True)
class Prefix(MultiTerm):
    prefix: str
    rewrite: str = "constant"
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"{named(self.field, default)}{self.prefix}*{_boost(self.boost)}"


@dataclass(frozen=True)
class Wildcard(MultiTerm):
    """* is any run of characters and ? is exactly one."""

    pattern: str
    rewrite: str = "constant"
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"{named(self.field, default)}{self.pattern}{_boost(self.boost)}"


@dataclass(frozen=True)
class Fuzzy(MultiTerm):
    term: str
    min_similarity: float = 0.5
    prefix_length: int = 0
    boost: float = 1.0

    def __post_init__(self) -> None:
        if not 0 <= self.min_similarity < 1:
            raise ValueError("0 <= min_similarity < 1")
        if self.prefix_length < 0:
            raise ValueError("prefix_length >= 0")

    def text(self, default: str = "") -> str:
        return f"{named(self.field, default)}{self.term}~{self.min_similarity}{_boost(self.boost)}"


@dataclass(frozen=True)
class TermRange(MultiTerm):
    low: str | None
    high: str | None
    include_low: bool = True
    include_high: bool = True
    collation: str | None = None
    rewrite: str = "constant"
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        ends = ("[" if self.include_low else "{"), ("]" if self.include_high else "}")
        return f"{named(self.field, default)}{ends[0]}{'*' if self.low is None else self.low} TO {'*' if self.high is None else self.high}{ends[1]}{_boost(self.boost)}"


@dataclass(frozen=True)
class TermSet(Query):
    """A disjunction of many weighted terms of one field, without a coordination factor: what expansion makes."""

    field: str
    weights: tuple[tuple[str, float], ...]
    boost: float = 1.0
    #: Document frequencies of the terms in order, where the expansion knows them.
    dfs: tuple[int, ...] | None = None

    def text(self, default: str = "") -> str:
        return " ".join(f"{named(self.field, default)}{t}{_boost(b)}" for t, b in self.weights)


@dataclass(frozen=True)
class NumericRange(Query):
    """A range over a numeric column; an open end is null."""

    field: str
    low: float | None
    high: float | None
    include_low: bool = True
    include_high: bool = True
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        ends = ("[" if self.include_low else "{"), ("]" if self.include_high else "}")
        return f"{named(self.field, default)}{ends[0]}{'*' if self.low is None else self.low} TO {'*' if self.high is None else self.high}{ends[1]}{_boost(self.boost)}"


@dataclass(frozen=True)
class MatchAll(Query):
    norms_field: str | None = None
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return "*:*" + _boost(self.boost)


@dataclass(frozen=True)
class ConstantScore(Query):
    """Every document of a filter, which is a query, a Filter, or a DataFrame function."""

    filter: Any
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"ConstantScore({self.filter}){_boost(self.boost)}"


@dataclass(frozen=True)
class Filtered(Query):
    query: Query
    filter: Any
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"filtered({self.query.text(default)})->{self.filter}{_boost(self.boost)}"


# --- value sources and custom scores -----------------------------------------------------------


@dataclass(frozen=True)
class ValueSource:
    """A number per document: a numeric column, the place of its string among all (ord), or from the end (rord)."""

    column: str
    kind: str = "value"  # value, ord or rord
    cast: str = "double"

    def __str__(self) -> str:
        return {"value": f"{self.cast}({self.column})", "ord": f"ord({self.column})", "rord": f"rord({self.column})"}[self.kind]


@dataclass(frozen=True)
class FieldScore(Query):
    source: ValueSource
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"{self.source}{_boost(self.boost)}"


@dataclass(frozen=True)
class CustomScore(Query):
    """boost * fn(sub score, source values ...); strict sources are not normalised."""

    query: Query
    sources: tuple[FieldScore, ...] = ()
    fn: Callable[..., Column] | None = None
    strict: bool = False
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"custom({', '.join([self.query.text(default), *(s.text(default) for s in self.sources)])}){' STRICT' if self.strict else ''}{_boost(self.boost)}"


# --- spans -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Span(Query):
    """Base of queries that match runs of positions."""


@dataclass(frozen=True)
class SpanTerm(Span):
    field: str
    term: str
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"{named(self.field, default)}{self.term}{_boost(self.boost)}"


@dataclass(frozen=True)
class SpanNear(Span):
    clauses: tuple[Span, ...]
    slop: int = 0
    in_order: bool = True
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"spanNear([{', '.join(c.text(default) for c in self.clauses)}], {self.slop}, {str(self.in_order).lower()}){_boost(self.boost)}"


@dataclass(frozen=True)
class SpanOr(Span):
    clauses: tuple[Span, ...]
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"spanOr([{', '.join(c.text(default) for c in self.clauses)}]){_boost(self.boost)}"


@dataclass(frozen=True)
class SpanNot(Span):
    include: Span
    exclude: Span
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"spanNot({self.include.text(default)}, {self.exclude.text(default)}){_boost(self.boost)}"


@dataclass(frozen=True)
class SpanFirst(Span):
    match: Span
    end: int
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"spanFirst({self.match.text(default)}, {self.end}){_boost(self.boost)}"


@dataclass(frozen=True)
class FieldMask(Span):
    """Spans of another field that pretend to be in ``field``."""

    query: Span
    field: str
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return f"mask({self.query.text(default)}){_boost(self.boost)} as {self.field}"


@dataclass(frozen=True)
class Payload(Span):
    """A span query scored with the payloads under its spans: fn is avg, min or max."""

    query: Span
    fn: str = "avg"
    include_span_score: bool = True
    boost: float = 1.0

    def text(self, default: str = "") -> str:
        return self.query.text(default) + _boost(self.boost)


def span_terms(q: Span) -> list[tuple[str, str]]:
    """Distinct (field, term) leaves of a span query, excluded spans not among them."""
    if isinstance(q, SpanTerm):
        return [(q.field, q.term)]
    if isinstance(q, SpanNot):
        return span_terms(q.include)
    if isinstance(q, (SpanFirst,)):
        return span_terms(q.match)
    if isinstance(q, (FieldMask, Payload)):
        return span_terms(q.query)
    return list(dict.fromkeys(t for c in q.clauses for t in span_terms(c)))


def simplify(q: Query) -> Query:
    """Rewrites that change scores and so belong to the tree: single clauses unwrap, one-term phrases are terms."""
    if isinstance(q, Boolean):
        kept = replace(q, clauses=tuple(Clause(c.occur, simplify(c.query)) for c in q.clauses))
        if len(kept.clauses) == 1 and not kept.min_should and kept.clauses[0].occur != MUST_NOT:
            inner = kept.clauses[0].query
            return inner.boosted(inner.boost * q.boost) if q.boost != 1.0 else inner
        return kept
    if isinstance(q, DisMax):
        inner = tuple(simplify(d) for d in q.disjuncts)
        if len(inner) == 1:
            return inner[0].boosted(inner[0].boost * q.boost) if q.boost != 1.0 else inner[0]
        return replace(q, disjuncts=inner)
    if isinstance(q, Phrase) and len(q.slots) == 1:
        slot = q.slots[0]
        if len(slot) == 1:
            return Term(q.field, slot[0], q.boost)
        return any_of(*[Term(q.field, t) for t in slot], disable_coord=True, boost=q.boost)
    if isinstance(q, Wildcard):
        if not any(c in q.pattern for c in "*?"):
            return replace(q)
        if q.pattern.endswith("*") and not any(c in q.pattern[:-1] for c in "*?"):
            return Prefix(q.field, q.pattern[:-1], q.rewrite, q.boost)
        return q
    if isinstance(q, Filtered):
        return replace(q, query=simplify(q.query))
    if isinstance(q, CustomScore):
        return replace(q, query=simplify(q.query))
    if isinstance(q, (SpanOr, SpanNear)) and len(q.clauses) == 1 and isinstance(q, SpanOr):
        inner = q.clauses[0]
        return replace(inner, boost=inner.boost * q.boost)
    return q
