"""Highlighting of hits: marked terms in the best fragments of a text.

A field's analyzer gives the tokens; its tokenizer's raw tokens give their places
in the text, since they stand there one after another.  A *marker* says which
tokens count and how much: ``TermMarker`` every occurrence of the query's terms,
``SpanMarker`` only those that take part in a match of a phrase or span query.
"""

from __future__ import annotations

import html
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.analysis import Analyzer
from tesserae.operators.positions import near_ordered, near_unordered, sloppy_frequency
from tesserae.plans import ast as A


def query_terms(q: A.Query, prohibited: bool = False, idf: Callable[[str], float] | None = None, field: str | None = None) -> dict[str, float]:
    """Weights of a query's terms, times ``idf`` if given; those of prohibited clauses, and of other fields, count only if asked for."""
    own = lambda x: field is None or getattr(x, "field", field) == field
    out: dict[str, float] = {}

    def walk(x: A.Query, b: float) -> None:
        b *= getattr(x, "boost", 1.0)
        if isinstance(x, (A.Term, A.SpanTerm)):
            if own(x):
                out[x.term] = max(out.get(x.term, 0.0), b)
        elif isinstance(x, A.Boolean):
            for c in x.clauses:
                if prohibited or c.occur != A.MUST_NOT:
                    walk(c.query, b)
        elif isinstance(x, A.DisMax):
            for d in x.disjuncts:
                walk(d, b)
        elif isinstance(x, A.Phrase) and own(x):
            for t in (t for s in x.slots for t in s):
                out[t] = max(out.get(t, 0.0), b)
        elif isinstance(x, A.ConstantScore) and isinstance(x.filter, A.Query):
            walk(x.filter, b)
        elif isinstance(x, A.TermSet) and own(x):
            for t, w in x.weights:
                out[t] = max(out.get(t, 0.0), b * w)
        elif isinstance(x, (A.Filtered, A.CustomScore)):
            walk(x.query, b)
        elif isinstance(x, A.SpanNot):
            walk(x.include, b)
        elif isinstance(x, A.SpanFirst):
            walk(x.match, b)
        elif isinstance(x, (A.SpanNear, A.SpanOr)):
            for c in x.clauses:
                walk(c, b)
        elif isinstance(x, (A.FieldMask, A.Payload)):
            walk(x.query, b)

    walk(q, 1.0)
    return {t: w * idf(t) for t, w in out.items()} if idf else out


def expanded(q: A.Query, view) -> A.Query:
    """The query with prefixes, wildcards, ranges and fuzzy terms as the terms of the view's dictionary, so that they are marked too."""
    from dataclasses import replace

    from tesserae.plans.search import expand

    def scoring(x):
        if isinstance(x, A.Boolean):
            return replace(x, clauses=tuple(A.Clause(c.occur, scoring(c.query)) for c in x.clauses))
        if isinstance(x, A.DisMax):
            return replace(x, disjuncts=tuple(map(scoring, x.disjuncts)))
        if isinstance(x, (A.Filtered, A.CustomScore)):
            return replace(x, query=scoring(x.query))
        if isinstance(x, A.ConstantScore) and isinstance(x.filter, A.Query):
            return replace(x, filter=scoring(x.filter))
        return replace(x, rewrite="scoring") if isinstance(x, (A.Prefix, A.Wildcard, A.TermRange)) else x

    return expand(scoring(A.simplify(q)), view)


@dataclass(frozen=True)
class Token:
    """A term at a position, and where its raw token stands in the text."""

    term: str
    pos: int
    start: int
    end: int


def tokens_of(text: str, raw: Iterable[str], stream: Iterable[tuple[str, int]]) -> list[Token]:
    """Tokens of a stream whose positions number the raw tokens; raw tokens stand in the text in order, in any case."""
    places, at = [], 0
    lowered = text.lower() if len(text.lower()) == len(text) else None
    for r in raw:
        k = text.find(r, at) if lowered is None else lowered.find(r.lower(), at)
        if k < 0:
            k = at  # a char filter changed it: it counts as standing where the last one ended
        places.append((k, min(len(text), k + len(r))))
        at = places[-1][1]
    return [Token(t, p, *places[p]) for t, p in stream if p < len(places)]


class TermMarker:
    """Every token that is a term of the query counts by the term's weight."""

    def __init__(self, query: A.Query, idf: Callable[[str], float] | None = None, field: str | None = None):
        self.weights = query_terms(query, idf=idf, field=field)

    def scores(self, tokens: list[Token]) -> list[float]:
        return [self.weights.get(t.term, 0.0) for t in tokens]


class SpanMarker:
    """Tokens count only where they take part in a match: phrases and span queries within their windows, other terms everywhere."""

    def __init__(self, query: A.Query, idf: Callable[[str], float] | None = None, field: str | None = None):
        self.query, self.weights, self.field = query, query_terms(query, idf=idf, field=field), field

    def scores(self, tokens: list[Token]) -> list[float]:
        at: dict[str, list[int]] = {}
        for t in tokens:
            at.setdefault(t.term, []).append(t.pos)
        at = {t: sorted(set(p)) for t, p in at.items()}
        found: set[tuple[str, int]] = set()
        self._mark(self.query, at, found)
        return [self.weights.get(t.term, 0.0) if (t.term, t.pos) in found else 0.0 for t in tokens]

    def _mark(self, q: A.Query, at: dict[str, list[int]], found: set[tuple[str, int]]) -> None:
        if isinstance(q, A.Boolean):
            for c in q.clauses:
                if c.occur != A.MUST_NOT:
                    self._mark(c.query, at, found)
        elif isinstance(q, A.DisMax):
            for d in q.disjuncts:
                self._mark(d, at, found)
        elif isinstance(q, (A.Filtered, A.CustomScore)):
            self._mark(q.query, at, found)
        elif isinstance(q, A.ConstantScore) and isinstance(q.filter, A.Query):
            self._mark(q.filter, at, found)
        elif isinstance(q, A.Phrase) and len(q.slots) > 1:
            lists = [sorted({p for t in s for p in at.get(t, [])}) for s in q.slots]
            spans = [[(p, p + 1) for p in own] for own in lists]
            if q.slop:
                groups = [next(j for j in range(len(q.slots)) if set(q.slots[j]) & set(q.slots[i])) for i in range(len(q.slots))]
                windows = near_unordered(spans, q.slop + q.positions[-1] + 1 - len(spans)) if sloppy_frequency(lists, q.positions, q.slop, groups) else []
                terms = {t for s in q.slots for t in s}
                found |= {(t, p) for t in terms for p in at.get(t, []) if any(s <= p < e for s, e in windows)}
            else:
                starts = set.intersection(*[{p - k for p in own} for own, k in zip(lists, q.positions)])
                found |= {(t, p + k) for p in starts for s, k in zip(q.slots, q.positions) for t in s if p + k in at.get(t, [])}
        elif isinstance(q, A.Span):
            windows = self._spans(q, at)
            found |= {(t, p) for _, t in A.span_terms(q) for p in at.get(t, []) if any(s <= p < e for s, e in windows)}
        else:
            found |= {(t, p) for t in query_terms(q, field=self.field) for p in at.get(t, [])}

    def _spans(self, q: A.Span, at: dict[str, list[int]]) -> list[tuple[int, int]]:
        if isinstance(q, A.SpanTerm):
            return [(p, p + 1) for p in at.get(q.term, [])]
        if isinstance(q, A.SpanOr):
            return sorted(x for c in q.clauses for x in self._spans(c, at))
        if isinstance(q, A.SpanFirst):
            return [x for x in self._spans(q.match, at) if x[1] <= q.end]
        if isinstance(q, A.SpanNot):
            out = self._spans(q.exclude, at)
            return [x for x in self._spans(q.include, at) if not any(x[0] < e and s < x[1] for s, e in out)]
        if isinstance(q, (A.FieldMask, A.Payload)):
            return self._spans(q.query, at)
        lists = [self._spans(c, at) for c in q.clauses]
        return lists[0] if len(lists) == 1 else (near_ordered if q.in_order else near_unordered)(lists, q.slop)


@dataclass
class Group:
    """Tokens that overlap in the text and are marked as one: the greatest of their scores counts, from the first to the last that has any."""

    start: int
    end: int
    tokens: list[Token]
    scores: list[float]

    @property
    def score(self) -> float:
        return max(self.scores)

    @property
    def marked(self) -> tuple[int, int]:
        some = [t for t, s in zip(self.tokens, self.scores) if s > 0]
        return min(t.start for t in some), max(t.end for t in some)


def token_groups(tokens: list[Token], scores: list[float]) -> list[Group]:
    out: list[Group] = []
    for t, s in sorted(zip(tokens, scores), key=lambda x: (x[0].start, x[0].end)):
        if out and t.start < out[-1].end:
            out[-1].end = max(out[-1].end, t.end)
            out[-1].tokens.append(t)
            out[-1].scores.append(s)
        else:
            out.append(Group(t.start, t.end, [t], [s]))
    return out


Fragmenter = Callable[[list[Group], str], list[int]]


def simple_fragmenter(size: int = 100) -> Fragmenter:
    """Groups that begin a fragment: each time the text has grown by ``size`` characters."""

    def begins(groups: list[Group], text: str) -> list[int]:
        out = [0]
        for k, g in enumerate(groups):
            if g.end >= size * len(out):
                out.append(k)
        return out

    return begins


def span_fragmenter(size: int = 100, reach: int = 20) -> Fragmenter:
    """As the simple one, but no fragment begins within ``reach`` groups behind a marked one that another marked one follows."""

    def begins(groups: list[Group], text: str) -> list[int]:
        marked = [k for k, g in enumerate(groups) if g.score > 0]
        inside = {k for a, b in zip(marked, marked[1:]) if b - a <= reach for k in range(a + 1, b + 1)}
        out, last = [0], 0
        for k, g in enumerate(groups):
            if g.end - last >= size and k not in inside:
                out.append(k)
                last = g.end
        return out

    return begins


def whole(groups: list[Group], text: str) -> list[int]:
    """One fragment."""
    return [0]


def best_fragments(text: str, tokens: list[Token], marker, n: int = 1, fragmenter: Fragmenter | None = None, mark: Callable[[str, float], str] | None = None, encode: Callable[[str], str] | None = None, merge: bool = True) -> list[tuple[str, float]]:
    """(marked fragment, score) of the best n; a fragment's score is the sum of the weights of its distinct marked terms."""
    fragmenter, mark, encode = fragmenter or simple_fragmenter(), mark or gradeless(tag()), encode or plain
    groups = token_groups(tokens, marker.scores(tokens))
    starts = sorted(set(fragmenter(groups, text)))
    parts: list[dict] = []
    at = 0
    for no, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(groups)])):
        out, terms = "", {}
        for g in groups[lo:hi]:
            a, b = g.marked if g.score > 0 else (g.start, g.end)
            out += encode(text[at:a]) + (mark(encode(text[a:b]), g.score) if g.score > 0 else encode(text[a:b]))
            at = b
            terms |= {t.term: s for t, s in zip(g.tokens, g.scores) if s > 0}
        end = groups[hi].start if hi < len(groups) else len(text)
        out += encode(text[at:end])
        at = end
        parts.append({"out": out, "score": sum(terms.values()), "no": no, "last": no})
    best = sorted((p for p in parts if p["score"] > 0), key=lambda p: (-p["score"], p["no"]))[:n]
    joined: list[dict] = []
    for p in sorted(best, key=lambda p: p["no"]):
        if merge and joined and joined[-1]["last"] + 1 == p["no"]:
            joined[-1] |= {"out": joined[-1]["out"] + p["out"], "score": max(joined[-1]["score"], p["score"]), "last": p["no"]}
        else:
            joined.append(p)
    return [(p["out"], p["score"]) for p in sorted(joined, key=lambda p: (-p["score"], p["no"]))]


def gradeless(mark: Callable[[str], str]) -> Callable[[str, float], str]:
    return lambda s, _: mark(s)


def gradient(most: float, low: str = "#FFFFFF", high: str = "#FF0000", element: str = "font", attribute: str = "color") -> Callable[[str, float], str]:
    """A tag whose colour runs from ``low`` to ``high`` as the score runs from 0 to ``most``."""
    ends = [[int(c[k : k + 2], 16) for k in (1, 3, 5)] for c in (low, high)]

    def mark(s: str, score: float) -> str:
        share = min(1.0, score / most) if most > 0 and not math.isnan(score) else 0.0
        colour = "#" + "".join(f"{round(a + (b - a) * share):02X}" for a, b in zip(*ends))
        return f'<{element} {attribute}="{colour}">{s}</{element}>'

    return mark


def span_gradient(most: float, low: str = "#FFFFFF", high: str = "#FF0000") -> Callable[[str, float], str]:
    """As ``gradient``, by a style."""
    plainly = gradient(most, low, high, "span", "style")
    return lambda s, score: plainly(s, score).replace('style="', 'style="background: ', 1)


def fragments(text: str, weights: dict[str, float], n: int, size: int, mark: Callable[[str], str], encode: Callable[[str], str], analyzed: int | None = None) -> list[tuple[str, float]]:
    """(marked fragment, score) of the best n fragments of about ``size`` characters; neighbours among them merge.

    A fragment's score is the sum of the weights of its distinct query terms;
    fragments without any are left out.  ``analyzed`` bounds the characters read.
    """
    import regex

    text = (text or "")[:analyzed]
    parts: list[dict] = [{"out": "", "terms": set(), "no": 0}]
    at = begin = 0
    for m in regex.finditer(r"\p{L}+", text):
        if m.end() >= begin + size * len(parts):
            parts[-1]["out"] += encode(text[at : m.start()])
            at = m.start()
            parts.append({"out": "", "terms": set(), "no": len(parts)})
        term = m.group().lower()
        parts[-1]["out"] += encode(text[at : m.start()])
        parts[-1]["out"] += mark(encode(m.group())) if term in weights else encode(m.group())
        if term in weights:
            parts[-1]["terms"].add(term)
        at = m.end()
    parts[-1]["out"] += encode(text[at:])
    for p in parts:
        p["score"] = sum(weights[t] for t in p["terms"])
    best = sorted((p for p in parts if p["score"] > 0), key=lambda p: (-p["score"], p["no"]))[:n]
    merged: list[dict] = []
    for p in sorted(best, key=lambda p: p["no"]):
        if merged and merged[-1]["last"] + 1 == p["no"]:
            merged[-1] = {"out": merged[-1]["out"] + p["out"], "score": max(merged[-1]["score"], p["score"]), "no": merged[-1]["no"], "last": p["no"]}
        else:
            merged.append({**p, "last": p["no"]})
    return [(p["out"], p["score"]) for p in sorted(merged, key=lambda p: (-p["score"], p["no"]))]


def tag(name: str = "B") -> Callable[[str], str]:
    return lambda s: f"<{name}>{s}</{name}>"


def plain(s: str) -> str:
    return s


def html_escape(s: str) -> str:
    return html.escape(s, quote=True)


def highlight(text: Column, query: A.Query, n: int = 1, size: int = 100, mark: Callable[[str], str] | None = None, encode: Callable[[str], str] = plain) -> Column:
    """array<string> of the best fragments of runs of letters; meant for the texts of hits, not of a whole table."""
    weights, put = query_terms(query), mark or tag()

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [f for f, _ in fragments(t, weights, n, size, put, encode)])

    return run(text)


def highlight_field(text: Column, analyzer: Analyzer, marker: TermMarker | SpanMarker, n: int = 1, fragmenter: Fragmenter | None = None, mark: Callable[[str, float], str] | None = None, encode: Callable[[str], str] | None = None) -> Column:
    """array<string> of the best fragments by the field's own analyzer; meant for the texts of hits, not of a whole table.

    Spark cannot hand the streams of n-gram filters to this step; for those,
    select raw tokens and stream first and call ``best_fragments``.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    raw = analyzer.tokenizer(analyzer.char_filter(text) if analyzer.char_filter else text)
    stream = analyzer(text)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series, raws: pd.Series, streams: pd.Series) -> pd.Series:
        return pd.Series([[f for f, _ in best_fragments(t, tokens_of(t, [x["term"] for x in r], [(x["term"], x["pos"]) for x in own]), marker, n, fragmenter, mark, encode)] for t, r, own in zip(s, raws, streams)])

    return run(text, raw, stream)


def highlight_whole(text: Column, terms: list[str], open_tag: str = "<B>", close_tag: str = "</B>") -> Column:
    """The whole text with its terms marked, by one regular expression."""
    words = "|".join("\\Q" + t + "\\E" for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, f"(?<!\\p{{L}})(?i:({words}))(?!\\p{{L}})", f"{open_tag}$1{close_tag}")
