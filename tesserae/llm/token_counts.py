"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic transducers.

* The *splitter* reads character classes.  Its transitions are annotated with
  the piece boundaries they emit.  Texts are cut into chunks; each chunk yields
  a map from entry state to exit state, the maps compose through a parallel
  prefix scan, and with the entry states known every chunk emits its boundaries.
* The *merger* reads the bytes of a piece.  Its transitions are annotated with
  the change in the number of emitted tokens.  A state holds the token starts
  still open, each with its trie node, the last token before it and the count
  there, which is all that later bytes can depend on, so the machine is finite.
  It is determinised on demand, and a distinct piece is read once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.encoding import byte_letters
from tesserae.llm.textcore import text_blocks, tidied

# character classes
LETTER, STMD, R, V, ELL, E, NUMBER, SPACE, WHITE, QUOTE, OTHER = range(11)
N_CLASS = 11
IDLE = 2 * N_CLASS  # padding; N_CLASS .. 2 * N_CLASS - 1 are classes of a text's first character
UNKNOWN = 255
# states: after a finished piece; in a run of letters, numbers, others; after a quote that may begin a
# contraction; that quote and r or v; that quote and l; one space; one other white character; two or more
# of them, the last a space; or not a space
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, WANT_E, WANT_L, ONE_SPACE, ONE_WHITE, SPACES, WHITES = range(11)
N_STATE = 11
#: A boundary before this character, before the previous one.
HERE, BACK = 1, 2
LETTERS = (LETTER, STMD, R, V, ELL, E)
CHUNK = 256
#: Steps that all entry states of a chunk take together before those that met go on as one.
MEET = 16


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted boundaries by (state, class)."""
    run = {c: IN_LETTERS for c in LETTERS} | {NUMBER: IN_NUMBERS, QUOTE: AT_QUOTE, OTHER: IN_OTHERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE}
    joined = run | {QUOTE: IN_OTHERS}
    nxt = np.zeros((N_STATE, 2 * N_CLASS + 1), np.uint8)
    out = np.zeros_like(nxt)
    for c in range(N_CLASS):
        white = c in (SPACE, WHITE)
        for s in range(N_STATE):
            to, emit = run[c], HERE
            if s == IN_LETTERS and c in LETTERS or s == IN_NUMBERS and c == NUMBER:
                emit = 0
            elif s == IN_OTHERS and c in (QUOTE, OTHER):
                to, emit = IN_OTHERS, 0
            elif s == AT_QUOTE and c in (STMD, R, V, ELL, QUOTE, OTHER):
                to, emit = {STMD: FRESH, R: WANT_E, V: WANT_E, ELL: WANT_L}.get(c, IN_OTHERS), 0
            elif s == WANT_E and c == E or s == WANT_L and c == ELL:
                to, emit = FRESH, 0
            elif s in (WANT_E, WANT_L):  # no contraction: the letter after the quote began a piece
                emit = BACK if c in LETTERS else BACK | HERE
            elif s in (ONE_SPACE, ONE_WHITE, SPACES, WHITES) and white:
                to, emit = (SPACES if c == SPACE else WHITES), 0
            elif s == ONE_SPACE:
                to, emit = joined[c], 0
            elif s == SPACES:
                to, emit = joined[c], BACK
            elif s == WHITES:
                emit = BACK | HERE
            nxt[s, c], out[s, c] = to, emit
        nxt[:, N_CLASS + c], out[:, N_CLASS + c] = run[c], HERE
    nxt[:, IDLE] = np.arange(N_STATE)
    return nxt, out


NEXT, EMIT = splitter()


def states_before(classes: np.ndarray) -> np.ndarray:
    """The splitter's state before each character, and at last the final one, by chunk maps and a prefix scan."""
    n = len(classes)
    blocks = max(1, -(-n // CHUNK))
    c = np.full(blocks * CHUNK, IDLE, np.uint8)
    c[:n] = classes
    c = np.ascontiguousarray(c.reshape(blocks, CHUNK).T)
    wide = NEXT.shape[1]
    table = np.ascontiguousarray(NEXT.reshape(-1))
    maps = np.broadcast_to(np.arange(N_STATE, dtype=np.int64), (blocks, N_STATE))
    for j in range(MEET):
        maps = table[maps * wide + c[j][:, None]].astype(np.int64)
    met = (maps == maps[:, :1]).all(axis=1)
    one, rest = maps[met, 0], maps[~met]
    for j in range(MEET, CHUNK):
        one = table[one * wide + c[j][met]].astype(np.int64)
        if len(rest):
            rest = table[rest * wide + c[j][~met][:, None]].astype(np.int64)
    maps = np.empty((blocks, N_STATE), np.int64)
    maps[met], maps[~met] = one[:, None], rest
    step = 1
    while step < blocks:  # maps[b] becomes the map of chunks 0 .. b
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    now = np.empty(blocks, np.int64)
    now[0], now[1:] = FRESH, maps[:-1, FRESH]
    states = np.empty((CHUNK, blocks), np.uint8)
    for j in range(CHUNK):
        states[j] = now
        now = table[now * wide + c[j]].astype(np.int64)
    return np.append(np.ascontiguousarray(states.T).reshape(-1)[:n], np.uint8(now[-1]))


class Merger:
    """The merge transducer of a byte-level BPE, built state by state as pieces need it."""

    #: States and remembered pieces; beyond these the process starts anew.
    MOST_STATES, MOST_PIECES = 120_000, 1_000_000

    def __init__(self, vocab: dict[str, int], merges: list):
        self.byte = {c: b for b, c in byte_letters().items()}
        self.vocab = {bytes(self.byte[c] for c in t): i for t, i in vocab.items() if all(c in self.byte for c in t)}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.rank = {}
        for k, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[bytes(self.byte[c] for c in a), bytes(self.byte[c] for c in b)] = k
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()
        n = 1
        for t, i in self.vocab.items():
            node = 0
            for b in t:
                self.inner.add(node)
                node_key = node << 8 | b
                node = self.child.get(node_key, 0)
                if not node:
                    self.child[node_key] = node = n
                    n += 1
            self.token_at[node] = i
        self.fits: dict[int, bool] = {}
        self.counts: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        start = (self._open(0, -1, 0),)
        self.states: list[tuple[int, ...]] = [start]
        self.number = {start: 0}
        self.step: dict[int, tuple[int, int]] = {}

    @staticmethod
    def _open(node: int, last: int, behind: int) -> int:
        """A token start: trie node reached since, token before it, tokens emitted since (which may be under zero)."""
        return (node << 20 | (last + 1)) << 12 | behind + 2048

    def merge(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _follows(self, last: int, token: int) -> bool:
        """Whether the tokens stand side by side in an encoding; last -1: at a piece's beginning."""
        key = (last + 1) << 20 | token
        found = self.fits.get(key)
        if found is None:
            a, b = self.tokens.get(last, b""), self.tokens[token]
            found = self.fits[key] = self.merge(a + b) == ([a, b] if a else [b])
            if len(self.fits) > 2_000_000:
                self.fits = {key: found}
        return found

    def _advance(self, state: int, byte: int) -> tuple[int, int]:
        reached, emitted = [], None
        last_token = -1
        for x in self.states[state]:
            behind, last, node = (x & 0xFFF) - 2048, (x >> 12 & 0xFFFFF) - 1, x >> 32
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            if to in self.inner:
                reached.append((to, last, behind))
            token = self.token_at.get(to)
            if emitted is None and token is not None and self._follows(last, token):
                emitted, last_token = 1 - behind, token
        if emitted is None:
            raise ValueError("the vocabulary has no token for some byte")
        new = tuple(self._open(to, last, behind + emitted) for to, last, behind in reached) + (self._open(0, last_token, 0),)
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        self.step[state << 8 | byte] = found = (number, emitted)
        return found

    def count(self, piece: bytes) -> int:
        """The piece's tokens."""
        state = total = 0
        step = self.step
        for byte in piece:
            found = step.get(state << 8 | byte) or self._advance(state, byte)
            state = found[0]
            total += found[1]
        if len(self.states) > self.MOST_STATES:
            self._clear()
        return total

    def count_all(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.counts) > self.MOST_PIECES:
            self.counts.clear()
        known = self.counts
        for p in pieces:
            if p not in known:
                known[p] = self.count(p)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


class CountingTransducer:
    """Both machines of a tokenizer file of the tokenizers library with the byte-level pre-tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space or normalizer can be compiled")
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        if any(x.get(flag) for x in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space with them or stand as words only are not compiled")
        self.merger = Merger(spec["model"]["vocab"], spec["model"]["merges"])
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        for c, k in ((" ", SPACE), ("'", QUOTE), ("r", R), ("v", V), ("l", ELL), ("e", E), *((x, STMD) for x in "stmd")):
            self.classes[ord(c)] = k

    def _classify(self, code: int) -> int:
        """A character's class, as the library's own splitter shows it."""
        c = chr(code)
        cut = [span for _, span in self.library.pre_tokenize_str(f"a{c}1")]
        if len(cut) == 2:
            return LETTER if cut[0][1] == 2 else NUMBER
        return WHITE if len(self.library.pre_tokenize_str(f"{c}{c}a")) == 3 else OTHER

    def _plain(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; added tokens' strings are ordinary here."""
        whole = "".join(texts)
        if not whole:
            return np.zeros(len(texts), np.int64)
        code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        begin = (ends - sizes)[sizes > 0]
        classes = self.classes[code]
        if (new := classes == UNKNOWN).any():
            for x in np.unique(code[new]).tolist():
                self.classes[x] = self._classify(x)
            classes = self.classes[code]
        classes[begin] += N_CLASS
        states = states_before(classes)
        emitted = EMIT[states[:-1], classes]
        cut = (emitted & HERE) > 0
        cut[:-1] |= (emitted[1:] & BACK) > 0
        # an unfinished contraction at a text's end
        final = states[np.append(begin[1:], len(code))]
        cut[np.append(begin[1:], len(code))[(final == WANT_E) | (final == WANT_L)] - 1] = True
        wide = np.ones(len(code) + 1, np.int64)
        wide[:-1] += (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        wide[-1] = 0
        at = np.cumsum(wide) - wide
        starts = np.flatnonzero(cut)
        bounds = np.append(at[starts], at[-1])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(whole.encode("utf-8"))]).dictionary_encode()
        n = self.merger.count_all(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
        sums = np.append(0, np.cumsum(n))
        first = np.searchsorted(starts, np.append(0, ends))
        return np.diff(sums[first])

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text as the library gives them, an added token's string counting one; null is empty."""
        import re

        special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        parts: list[str] = []
        owner: list[int] = []
        extra = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t and special and any(x in t for x in self.added):
                split = special.split(t)
                extra[k] = len(split) - 1
                parts += split
                owner += [k] * len(split)
            else:
                parts.append(t or "")
                owner.append(k)
        n = self._plain(parts)
        return extra + np.bincount(np.asarray(owner, np.int64), n, len(texts)).astype(np.int64)


_compiled: dict[str, CountingTransducer] = {}


def transducer(path: str) -> CountingTransducer:
    if path not in _compiled:
        _compiled[path] = CountingTransducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, in one pass without a shuffle.

    Counts are those of ``encode(text, add_special_tokens=False)``.  Null texts
    are empty: no bytes, no tokens.  Null ids and repeated rows stay as they
    are; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for b in batches:
            texts = b.column(2)
            parts = [machine.counts(texts.slice(i, j - i).to_pylist()) for i, j in text_blocks(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(parts) if parts else [], pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("t"))
    counted = rows.mapInArrow(tidied(run), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
