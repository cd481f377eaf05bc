"""Analysis as column expressions: tokenizers, token filters and named analyzers.

A token stream is a column ``array<struct<term string, pos int>>``.  Positions
start at 0; a filter that drops tokens leaves gaps unless told to close them.
Everything is built from JVM-side functions except the standard tokenizer and
the stemmers, which read whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import stemmers, stopwords

Stream = Column
Filter = Callable[[Stream], Stream]

#: Longest run a character tokenizer emits as one token.
MAX_RUN = 255

#: Tokens that a Python step holds as objects at once; all others of its batch stay in Arrow arrays.
TOKEN_BLOCK = 1 << 17

# The 33 English stop words.
ENGLISH_STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def stream(terms: Column) -> Stream:
    """A token stream of terms at positions 0, 1, 2 ..."""
    return F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.cast("int").alias("pos")))


def map_terms(fn: Callable[[Column], Column]) -> Filter:
    return lambda s: F.transform(s, lambda x: F.struct(fn(x["term"]).alias("term"), x["pos"].alias("pos")))


def _lists(n: pa.Array, missing: pa.Array, **fields: pa.Array) -> pa.Array:
    """Lists of n structs each, null where missing."""
    at = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(n.cast(pa.int32()))])
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=missing)


# --- tokenizers: text column -> stream ---------------------------------------------------------


def _runs(cls: str) -> Callable[[Column], Stream]:
    # an explicit lit keeps the group index a constant, so the pattern is compiled once
    return lambda text: stream(F.regexp_extract_all(text, F.lit(f"({cls}){{1,{MAX_RUN}}}"), F.lit(0)))


whitespace = _runs("[^\\p{Z}\\t\\n\\r\\f]")
letter = _runs("\\p{L}")
russian_letter = _runs("[\\p{L}\\p{Nd}]")
arabic_letter = _runs("[\\p{L}\\p{Mn}]")


def lowercase_letter(text: Column) -> Stream:
    return letter(F.lower(text))


def keyword(text: Column) -> Stream:
    """The whole text as one token; a null text has none."""
    return stream(F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text)))


def chinese(text: Column) -> Stream:
    """Single letters without case, runs of letters with case, runs of digits."""
    return stream(F.transform(F.regexp_extract_all(text, F.lit(f"[\\p{{Lu}}\\p{{Ll}}]{{1,{MAX_RUN}}}|\\p{{Nd}}{{1,{MAX_RUN}}}|\\p{{Lo}}"), F.lit(0)), F.lower))


def cjk(text: Column) -> Stream:
    """Lower-cased runs of ASCII letters, digits, _ + #; overlapping pairs of other letters."""
    folded = F.lower(F.translate(text, "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))))
    runs = F.regexp_extract_all(folded, F.lit("[a-z0-9_+#]+|[\\p{L}&&[^a-z]]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return stream(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9_+#]") | (F.length(r) < 2), F.array(r)).otherwise(pairs(r)))))


def _from(t: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(t, i, F.lit(n))


def _grams(t: Column, low: int, high: int) -> Column:
    """Grams of low .. high characters, by start and then by size."""
    starts = F.when(F.length(t) >= low, F.sequence(F.lit(1), F.greatest(F.length(t) - low + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(t) - i + 1)), lambda n: F.substring(t, i, n))

    return F.flatten(F.transform(starts, at))


def ngram(low: int = 1, high: int = 2) -> Callable[[Column], Stream]:
    """All grams of low .. high characters of the whole text, by start and then by size."""
    if not 1 <= low <= high:
        raise ValueError("1 <= low <= high")
    return lambda text: stream(_grams(text, low, high))


def edge_ngram(low: int = 1, high: int = 1, side: str = "front") -> Callable[[Column], Stream]:
    """Prefixes, or suffixes at side "back", of low .. high characters of the whole text."""
    return lambda text: stream(_edges(text, low, high, side))


def _edges(t: Column, low: int, high: int, side: str) -> Column:
    if side not in ("front", "back"):
        raise ValueError("side is front or back")
    cut = F.left if side == "front" else F.right
    return F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.length(t) >= n, cut(t, n))), lambda x: x.isNotNull())


def numeric_tokens(step: int = 4) -> Callable[[Column], Stream]:
    """A whole number as terms of every precision, the full one first, all at one position; null has none."""
    from tesserae.functions.codecs import trie_terms

    def tokens(x: Column) -> Stream:
        terms = F.when(x.try_cast("long").isNull(), F.array().cast("array<string>")).otherwise(trie_terms(x.try_cast("long"), step))
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0).alias("pos")))

    return tokens


# The token classes of the standard tokenizer, fixed by its published grammar.
_CJ = "㄀-ㄯ぀-ゟ゠-ヿㇰ-ㇿ㌀-㍿㐀-䶿一-鿿豈-﫿･-ﾟ"
_LETTER = rf"[\p{{L}}--[{_CJ}]]"
_ALNUM = rf"[[\p{{L}}--[{_CJ}]]||\p{{Nd}}]"
_WORD, _ALPHA, _PUNCT = f"{_ALNUM}+", f"{_LETTER}+", "[_/.,-]"
_DIGITS = rf"{_ALNUM}*\p{{Nd}}{_ALNUM}*"
STANDARD_TYPES = {
    "<ALPHANUM>": _WORD,
    "<APOSTROPHE>": f"{_ALPHA}(?:'{_ALPHA})+",
    "<ACRONYM>": rf"{_LETTER}\.(?:{_LETTER}\.)+",
    "<COMPANY>": f"{_ALPHA}[&@]{_ALPHA}",
    "<EMAIL>": rf"{_WORD}(?:[._-]{_WORD})*@{_WORD}(?:[.-]{_WORD})+",
    "<HOST>": rf"{_WORD}(?:\.{_WORD})+",
    "<NUM>": "|".join((f"{_WORD}{_PUNCT}{_DIGITS}", f"{_DIGITS}{_PUNCT}{_WORD}", f"{_WORD}(?:{_PUNCT}{_DIGITS}{_PUNCT}{_WORD})+", f"{_DIGITS}(?:{_PUNCT}{_WORD}{_PUNCT}{_DIGITS})+", f"{_WORD}{_PUNCT}{_DIGITS}(?:{_PUNCT}{_WORD}{_PUNCT}{_DIGITS})+", f"{_DIGITS}{_PUNCT}{_WORD}(?:{_PUNCT}{_DIGITS}{_PUNCT}{_WORD})+")),
    "<CJ>": f"[{_CJ}]",
    "<ACRONYM_DEP>": rf"{_WORD}\.(?:{_WORD}\.)+",
}
#: Runs of all characters that a token may have: no token spans two of them, so each distinct run is read once.
_CHUNK = rf"[\p{{L}}\p{{Nd}}{_CJ}'.&@_/,\-]+"
#: Distinct runs that a process remembers, and the longest of them in characters.
CHUNKS_KNOWN, CHUNK_LONG = 1 << 16, 64
_standard: list = []


def _chunk_tokens(chunk: str, longest: int) -> list[tuple[str | None, str | None]]:
    """(term, type) of the longest matches in a run; nulls for an over-long one."""
    out: list[tuple[str | None, str | None]] = []
    if (word := _standard[4].fullmatch(chunk)) and len(word[1]) <= longest:
        return [(word[1], "<ALPHANUM>")]  # a word, and no other to join
    for m in _standard[0].finditer(chunk):
        term = m.group()
        if len(term) > longest:
            out.append((None, None))
            continue
        kind = next(t for t, p in _standard[1] if p.fullmatch(term))
        out.append(("<HOST>", term[:-1])[::-1] if kind == "<ACRONYM_DEP>" else (term, kind))
    return out


def standard_tokens(text: str | None, longest: int = MAX_RUN) -> list[tuple[str, int, str]]:
    """(term, position, type) of the longest matches; over-long ones go but leave their position."""
    import regex

    if not _standard:
        # V1 syntax for set differences, POSIX matching for the longest alternative
        _standard.append(regex.compile("(?V1p)" + "|".join(f"(?:{p})" for p in STANDARD_TYPES.values())))
        _standard.append([(t, regex.compile(f"(?V1)(?:{p})")) for t, p in STANDARD_TYPES.items()])
        _standard.append(regex.compile(f"(?V1){_CHUNK}"))
        _standard.append({})
        _standard.append(regex.compile(rf"(?V1)['.&@_/,\-]*({_WORD})['.&@_/,\-]*"))
    out, pos, known = [], 0, _standard[3]
    for m in _standard[2].finditer(text or ""):
        chunk = m.group()
        own = known.get((chunk, longest))
        if own is None:
            own = _chunk_tokens(chunk, longest)
            if len(chunk) <= CHUNK_LONG:
                if len(known) >= CHUNKS_KNOWN:
                    known.clear()
                known[chunk, longest] = own
        for term, kind in own:
            if term is not None:
                out.append((term, pos, kind))
            pos += 1
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("type", T.StringType())])))
def _standard_stream(text: pa.Array) -> pa.Array:
    n, held, done = [], [], []

    def put() -> None:
        terms, places, kinds = zip(*held) if held else ((), (), ())
        done.append([pa.array(terms, pa.string()), pa.array(places, pa.int32()), pa.array(kinds, pa.string())])
        held.clear()

    for t in text:
        own = standard_tokens(t.as_py())
        n.append(len(own))
        held += own
        if len(held) >= TOKEN_BLOCK:
            put()
    put()
    term, pos, kind = map(pa.concat_arrays, zip(*done))
    return _lists(pa.array(n, pa.int32()), pa.array([False] * len(n)), term=term, pos=pos, type=kind)


def standard(text: Column) -> Stream:
    """Typed tokens; the type goes after ``standard_filter``."""
    return _standard_stream(text)


def standard_filter(s: Stream) -> Stream:
    """Drops 's from possessives and the dots from acronyms, and then the types."""
    return F.transform(
        s,
        lambda x: F.struct(
            F.when((x["type"] == "<APOSTROPHE>") & F.lower(F.right(x["term"], F.lit(2))).eqNullSafe("'s"), F.substring(x["term"], F.lit(1), F.length(x["term"]) - 2)).when(x["type"] == "<ACRONYM>", F.replace(x["term"], F.lit("."), F.lit(""))).otherwise(x["term"]).alias("term"),
            x["pos"].alias("pos"),
        ),
    )


# --- token filters: stream -> stream -----------------------------------------------------------

lower = map_terms(F.lower)
reverse = map_terms(F.reverse)


def reverse_marked(marker: str) -> Filter:
    return map_terms(lambda t: F.concat(F.lit(marker), F.reverse(t)))


def stop(words: Iterable[str], keep_gaps: bool = True, ignore_case: bool = False) -> Filter:
    own = sorted({w.lower() for w in words} if ignore_case else set(words))

    def apply(s: Stream) -> Stream:
        kept = F.filter(s, lambda x: ~(F.lower(x["term"]) if ignore_case else x["term"]).isin(own)) if own else s
        return kept if keep_gaps else closed(kept)

    return apply


def closed(s: Stream) -> Stream:
    """Positions without gaps."""
    return stream(F.transform(s, lambda x: x["term"]))


def length(low: int, high: int) -> Filter:
    return lambda s: closed(F.filter(s, lambda x: F.length(x["term"]).between(low, high)))


def elision(articles: Iterable[str] = ("l", "m", "t", "qu", "n", "s", "j")) -> Filter:
    pattern = "^(?i:" + "|".join(sorted(articles, key=len, reverse=True)) + ")['’]"
    return map_terms(lambda t: F.regexp_replace(t, pattern, ""))


def _from(t: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(t, i, F.lit(n))


def ngram_filter(low: int = 1, high: int = 2, preserve: bool = False) -> Filter:
    """Grams of each token at its position, by size and then by start; tokens outside low .. high stay if preserved."""
    def grams(x: Column) -> Column:
        t = x["term"]
        sized = [F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), _from(t, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        own = F.concat(*sized, F.when(F.lit(preserve) & ((F.length(t) < low) | (F.length(t) > high)), F.array(t)).otherwise(F.array().cast("array<string>")))
        return _at(own, x["pos"])

    return lambda s: F.flatten(F.transform(s, grams))


def _at(terms: Column, pos: Column) -> Stream:
    """Terms at one position; a lambda that read the position from around it could not go to a Python step."""
    return F.arrays_zip(terms.alias("term"), F.array_repeat(pos, F.size(terms)).alias("pos"))


def edge_ngram_filter(low: int = 1, high: int = 1, preserve: bool = False, side: str = "front") -> Filter:
    def grams(x: Column) -> Column:
        t = x["term"]
        own = _edges(t, low, high, side)
        extra = F.when(F.lit(preserve) & ((F.length(t) < low) | (F.length(t) > high)), F.array(t)).otherwise(F.array().cast("array<string>"))
        return _at(F.concat(own, extra), x["pos"])

    return lambda s: F.flatten(F.transform(s, grams))


def fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one ASCII character, and those that fold to more, by Unicode decomposition."""
    import unicodedata

    # Letters that do not decompose.
    special = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l", "Þ": "TH", "þ": "th", "ı": "i", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t", "ĸ": "q", "Ŋ": "N", "ŋ": "n", "ſ": "s"}
    one, to, many = [], [], {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x2460, 0x24EA), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]):
        folded = special.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())
        if len(folded) == 1:
            one.append(c)
            to.append(folded)
        elif folded:
            many[c] = folded
    return "".join(one), "".join(to), many


def fold(term: Column) -> Column:
    """Accented and other letters in ASCII."""
    one, to, many = fold_table()
    out = F.translate(term, one, to)
    # ligatures are rare: the replacements run only where one stands
    folded = out
    for c, s in many.items():
        folded = F.replace(folded, F.lit(c), F.lit(s))
    return F.when(out.rlike("[^\\x00-\\x7f]"), folded).otherwise(out)


ascii_folding = map_terms(fold)


def fold_latin1(term: Column) -> Column:
    """Accented letters of Latin 1 and its ligatures without their accents; all others stay."""
    one, to, many = fold_table()
    kept = [(c, d) for c, d in zip(one, to) if c < "Ā"] + [("Ÿ", "Y")]
    out = F.translate(term, *("".join(x) for x in zip(*kept)))
    for c, d in many.items():
        if c in "ÆæÞþßŒœĲĳﬀﬁﬂ":
            out = F.replace(out, F.lit(c), F.lit(d))
    # a term of single bytes has none of these letters
    return F.when(F.octet_length(term) > F.length(term), out).otherwise(term)


latin1_folding = map_terms(fold_latin1)


def tee(s: Stream, *sinks: Callable[[Column], Column]) -> list[Stream]:
    """The stream, and for each sink the tokens that it accepts; the tokenizer's work is done once for all."""
    return [s, *[F.filter(s, accept) for accept in sinks]]


def word_list(lines: Iterable[str], comment: str | None = None) -> list[str]:
    """Words of a list of one word a line, trimmed; empty lines, and lines that begin with ``comment``, count nothing."""
    words = (x.strip() for x in lines)
    return [w for w in words if w and not (comment and w.startswith(comment))]


def stem_dictionary(lines: Iterable[str]) -> dict[str, str]:
    """Word and stem of each line, with a tab between them."""
    return dict(x.split("\t", 1) for x in word_list(lines) if "\t" in x)


def read_words(spark, path: str, comment: str | None = None) -> list[str]:
    """A word list from a text file on any filesystem of the session; meant for lists that a driver holds."""
    return word_list((r["value"] for r in spark.read.text(path).toLocalIterator()), comment)


def char_map(table: dict[str, str]) -> Callable[[Column], Column]:
    """A text with the longest key at each place replaced, left to right, without reading replacements again."""
    def apply(text: Column) -> Column:
        keys = sorted(table, key=len, reverse=True)
        import re

        quoted = "|".join("\\Q" + k + "\\E" for k in keys)
        pieces = F.regexp_extract_all(text, F.lit(f"(?s){quoted}|."), F.lit(0))
        pairs = F.create_map(*[F.lit(x) for k in keys for x in (k, table[k])])
        return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(pairs, p), p)), "")

    return apply if table else (lambda text: text)


GREEK_FROM = "ΆΈΉΊΌΎΏάέήίόύώϊϋΐΰςΪΫ"
GREEK_TO = "αεηιουωαεηιουωιυιυσιυ"
russian_lower = lower
greek_lower = map_terms(lambda t: F.lower(F.translate(t, GREEK_FROM, GREEK_TO)))
# tatweel and the short vowel signs go; forms of alef, yeh and teh marbuta fold
arabic_normalize = map_terms(lambda t: F.translate(t, "آأإىةـًٌٍَُِّْ", "ااايه"))
persian_normalize = map_terms(lambda t: F.translate(t, "یےکۀۂ", "ييكهه"))


def stem(name: str, exclude: Iterable[str] = (), override: dict[str, str] | None = None) -> Filter:
    """Stems by the named algorithm, over whole batches that stay in Arrow's own layout; each distinct term is stemmed once a block of tokens."""
    kept, fixed = frozenset(exclude), dict(override or {})
    fn = stemmers.by_name(name)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("pos", T.IntegerType())])))
    def run(s: pa.Array) -> pa.Array:
        def one(t: str | None) -> str | None:
            return fixed[t] if t in fixed else t if t is None or t in kept else fn(t)

        n = pc.fill_null(pc.list_value_length(s), 0)
        tokens, out = s.flatten(), []
        for i in range(0, len(tokens), TOKEN_BLOCK):
            terms = pc.struct_field(tokens.slice(i, TOKEN_BLOCK), "term").dictionary_encode()
            out.append(pa.array(map(one, terms.dictionary.to_pylist()), pa.string()).take(terms.indices))
        stems = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return _lists(n, s.is_null(), term=stems, pos=pc.struct_field(tokens, "pos"))

    return run


# --- analyzers ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer, filters in order, and the gap between values of a repeated field; streams are whole unless ``max_tokens`` cuts them."""

    tokenizer: Callable[[Column], Stream]
    filters: tuple[Filter, ...] = ()
    char_filter: Callable[[Column], Column] | None = None
    position_gap: int = 0
    max_tokens: int | None = None

    def __call__(self, text: Column) -> Stream:
        text = F.coalesce(text.cast("string"), F.lit("")) if self.tokenizer is not keyword else text
        s = self.tokenizer(self.char_filter(text) if self.char_filter else text)
        for f in self.filters:
            s = f(s)
        return self._cut(s)

    def of_values(self, values: Column) -> Stream:
        """The stream of a repeated field: each value continues behind the last, after the gap."""
        parts = F.transform(values, lambda v: self(v))
        empty = F.struct(F.array().cast("array<struct<term:string,pos:int>>").alias("all"), F.lit(0).alias("next"))
        joined = F.aggregate(
            parts,
            empty,
            lambda acc, p: F.struct(
                F.concat(acc["all"], F.transform(p, lambda x: F.struct(x["term"].alias("term"), (x["pos"] + acc["next"]).cast("int").alias("pos")))).alias("all"),
                F.when(F.size(p) > 0, acc["next"] + F.element_at(p, -1)["pos"] + 1 + self.position_gap).otherwise(acc["next"]).cast("int").alias("next"),
            ),
        )
        return self._cut(joined["all"])

    def _cut(self, s: Stream) -> Stream:
        return s if self.max_tokens is None else F.slice(s, 1, self.max_tokens)


def stop_analyzer(words: Iterable[str] = ENGLISH_STOP_WORDS) -> Analyzer:
    return Analyzer(lowercase_letter, (stop(words),))


def standard_analyzer(words: Iterable[str] = ENGLISH_STOP_WORDS) -> Analyzer:
    return Analyzer(standard, (standard_filter, lower, stop(words)))


def snowball_analyzer(name: str, words: Iterable[str] = ()) -> Analyzer:
    return Analyzer(standard, (standard_filter, lower, stop(words), stem(name)))


def german_analyzer(words: Iterable[str] = stopwords.GERMAN, exclude: Iterable[str] = ()) -> Analyzer:
    return Analyzer(standard, (standard_filter, lower, stop(words), stem("german", exclude)))


def arabic_analyzer(words: Iterable[str] = stopwords.ARABIC) -> Analyzer:
    return Analyzer(arabic_letter, (lower, stop(words), arabic_normalize, stem("arabic")))


def persian_analyzer(words: Iterable[str] = ()) -> Analyzer:
    return Analyzer(arabic_letter, (lower, arabic_normalize, persian_normalize, stop(words)))


def greek_analyzer(words: Iterable[str] = stopwords.GREEK) -> Analyzer:
    return Analyzer(standard, (standard_filter, greek_lower, stop(words)))


def czech_analyzer(words: Iterable[str] = stopwords.CZECH) -> Analyzer:
    return Analyzer(standard, (standard_filter, lower, stop(words)))


def french_analyzer(words: Iterable[str] = stopwords.FRENCH, exclude: Iterable[str] = ()) -> Analyzer:
    """Stop words go before case is folded; excluded words are not stemmed."""
    return Analyzer(standard, (standard_filter, stop(words), lower, stem("french", exclude)))


def dutch_analyzer(words: Iterable[str] = stopwords.DUTCH, exclude: Iterable[str] = (), override: dict[str, str] | None = None) -> Analyzer:
    # Words whose stem the algorithm would miss.
    fixed = {"fiets": "fiets", "bromfiets": "bromfiets", "ei": "eier", "kind": "kinder"} if override is None else override
    return Analyzer(standard, (standard_filter, stop(words), lower, stem("dutch", exclude, fixed)))


def brazilian_analyzer(words: Iterable[str] = stopwords.BRAZILIAN, exclude: Iterable[str] = ()) -> Analyzer:
    return Analyzer(standard, (standard_filter, lower, stop(words), stem("brazilian", exclude)))


def russian_analyzer(words: Iterable[str] = stopwords.RUSSIAN) -> Analyzer:
    return Analyzer(russian_letter, (lower, stop(words), stem("russian")))


def cjk_analyzer(words: Iterable[str] = ENGLISH_STOP_WORDS) -> Analyzer:
    return Analyzer(cjk, (stop(words),))


def chinese_analyzer(words: Iterable[str] = ENGLISH_STOP_WORDS) -> Analyzer:
    """Drops stop words and single Latin letters."""
    alone = lambda s: F.filter(s, lambda x: ~((F.length(x["term"]) == 1) & x["term"].rlike("[\\p{Lu}\\p{Ll}]")))
    return Analyzer(chinese, (stop(words), alone))


def ngram_analyzer(low: int = 1, high: int = 2) -> Analyzer:
    return Analyzer(ngram(low, high))


def edge_ngram_analyzer(low: int = 1, high: int = 1, side: str = "front") -> Analyzer:
    return Analyzer(edge_ngram(low, high, side))


def numeric(step: int = 4) -> Analyzer:
    return Analyzer(numeric_tokens(step))


WHITESPACE, SIMPLE, KEYWORD = Analyzer(whitespace), Analyzer(lowercase_letter), Analyzer(keyword)


@dataclass(frozen=True)
class PerField:
    """An analyzer for each field, and one for the rest."""

    default: Analyzer
    fields: dict[str, Analyzer] = field(default_factory=dict)

    def of(self, name: str) -> Analyzer:
        return self.fields.get(name, self.default)
