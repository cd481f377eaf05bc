"""Token ids of whole texts by the public byte-level BPE, a batch at a time.

The library encodes each *distinct* chunk once.  Chunks are cut only where the
tokenizer's own pre-tokenizer always cuts too: between ASCII letters, digits and
other marks (but not behind an apostrophe, which may begin a contraction), before
white space, and behind a lone line end or tab.  Other white space stays with
what follows it, bytes beyond ASCII are cut from nothing but white space before
a text's next word, and a text that holds an added token's string is encoded
whole, so ids equal ``Tokenizer.encode`` on the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tesserae.llm.textcore import gather_runs, utf8_buffer

#: Bytes of distinct chunks and ids a Python worker remembers, with the dictionary's own; then it forgets all but the current batch's.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 160

# What a byte is to the pre-tokenizer: a space, other white space, a letter, a digit, an apostrophe, a mark, or part of a longer character.
SPACE, BREAK, LETTER, DIGIT, APOSTROPHE, MARK, LONG = range(7)
KIND = np.full(256, MARK, np.uint8)
KIND[32], KIND[9:14], KIND[39], KIND[48:58], KIND[65:91], KIND[97:123] = SPACE, BREAK, APOSTROPHE, DIGIT, LETTER, LETTER
KIND[28:32] = KIND[128:] = LONG
# CUTS[a, b]: whether a chunk may end between bytes of kinds a and b, whatever stands around them
CUTS = np.zeros((7, 7), bool)
CUTS[[[LETTER], [DIGIT], [APOSTROPHE], [MARK]], [SPACE, BREAK]] = True
CUTS[LETTER, [DIGIT, APOSTROPHE, MARK]] = CUTS[DIGIT, [LETTER, APOSTROPHE, MARK]] = CUTS[MARK, [LETTER, DIGIT]] = True
CUTS[APOSTROPHE, DIGIT] = True
PAIR_CUTS = CUTS.ravel()
# bytes that may begin and end a white character beyond ASCII (U+0085 A0 1680 180E 2000-200A 2028 2029 202F 205F 3000)
BEGINS_WHITE, ENDS_WHITE = np.zeros(256, bool), np.zeros(256, bool)
BEGINS_WHITE[[0xC2, 0xE1, 0xE2, 0xE3, *range(28, 32)]] = True
ENDS_WHITE[[*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(28, 32)]] = True
#: A chunk that is one piece: letters, digits or marks, with a space before them or none.
ONE_PIECE = r"^ ?([A-Za-zÀ-ÖØ-öø-ſ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)$"

# Chunks of these characters alone are cut by PIECE; the library cuts all others.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r -~À-ÖØ-öø-ſ]*")
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PIECE = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
APART = "\ue000"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable character for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class BatchEncoder:
    """Ids of batches of texts; ``path`` names a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        letters = byte_letters()
        self.table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x180)} | {ord(APART): "\n"}
        if self.by_chunk:
            self.pieces = Tokenizer(self.tokenizer.model)
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.width = np.zeros(max(vocab.values()) + 1, np.int64)
            self.width[list(vocab.values())] = [len(w) for w in vocab]
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.chunks: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.n_chunks = self.n_ids = self.held = 0

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep(self, chunks: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = self.n_chunks + len(chunks), self.n_ids + len(ids)
        if m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * m)
        if n + 1 > len(self.at):
            self.at = np.resize(self.at, 2 * (n + 1))
        self.ids[self.n_ids : m] = ids
        self.at[self.n_chunks + 1 : n + 1] = self.n_ids + np.cumsum(lengths)
        self.chunks.update(zip(chunks, range(self.n_chunks, n)))
        self.n_chunks, self.n_ids = n, m
        self.held += sum(map(len, chunks)) + ENTRY_BYTES * len(chunks) + 4 * len(ids)

    def _forget(self, but: list[bytes]) -> None:
        """Drops all chunks but these."""
        number = np.fromiter(map(self.chunks.__getitem__, but), np.int64, len(but))
        lengths = self.at[number + 1] - self.at[number]
        ids = self.ids[gather_runs(self.at[number], lengths)]
        self.chunks.clear()
        self.n_chunks = self.n_ids = self.held = 0
        self._keep(but, ids, lengths)

    def _by_piece(self, pieces: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in the byte-level alphabet, end to end, and how many each has; sizes: their bytes."""
        found = [x.ids for x in self.pieces.encode_batch_fast([pieces[i : i + 2000] for i in range(0, len(pieces), 2000)], is_pretokenized=True, add_special_tokens=False)]
        ids = np.concatenate([np.asarray(x, np.uint32) for x in found])
        # the bytes of a piece's tokens add up to its own
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)

    def _spelled(self, pieces: list[str]) -> list[str]:
        """Pieces of PLAIN characters in the byte-level alphabet."""
        return [x for i in range(0, len(pieces), 2000) for x in APART.join(pieces[i : i + 2000]).translate(self.table).split("\n")]

    def _learn(self, chunks: list[bytes]) -> None:
        texts = pa.array(chunks, pa.large_binary()).cast(pa.large_string())
        one = pc.match_substring_regex(texts, ONE_PIECE)
        single, rest = texts.filter(one), texts.filter(pc.invert(one)).to_pylist()
        ascii_only = pc.string_is_ascii(single)
        for part, spell in ((single.filter(ascii_only), lambda x: pc.replace_substring(x, " ", "Ġ").to_pylist()), (single.filter(pc.invert(ascii_only)), lambda x: self._spelled(x.to_pylist()))):
            if len(part):
                self._keep(part.cast(pa.large_binary()).to_pylist(), *self._by_piece(spell(part), pc.binary_length(part).to_numpy()))
        plain, other = [], []
        for x in rest:
            (plain if PLAIN.fullmatch(x) else other).append(x)
        if plain:
            cut = [PIECE.findall(x) for x in plain]
            flat = [p for pieces in cut for p in pieces]
            ids, tokens = self._by_piece(self._spelled(flat), np.asarray([len(p.encode()) for p in flat]))
            sums = np.append(0, np.cumsum(tokens))
            self._keep([x.encode() for x in plain], ids, np.diff(sums[np.append(0, np.cumsum([len(c) for c in cut]))]))
        if other:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            self._keep([x.encode() for x in other], np.asarray([i for x in found for i in x], np.uint32), np.asarray([len(x) for x in found]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts, end to end, and n + 1 offsets. Nulls are empty."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        apart = np.zeros(n, bool)
        for s in self.added:
            apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not self.by_chunk:
            apart[:] = True
        flat, offsets = utf8_buffer(texts)
        if apart.any():
            return self._mixed(texts, apart)
        # a chunk begins at each text's start, and where two kinds of byte part
        kind = KIND[flat]
        cut = np.zeros(len(flat), bool)
        if len(flat):
            cut[1:] = PAIR_CUTS[kind[:-1] * np.uint8(7) + kind[1:]]
            # a lone space after a longer character, and what follows a lone line end
            white = kind <= BREAK
            lone = white.copy()
            lone[1:] &= ~white[:-1]
            lone[:-1] &= ~white[1:]
            after, before = lone.copy(), lone.copy()  # a white character beyond ASCII may stand on that side
            after[:-1] &= BEGINS_WHITE[flat[1:]]
            before[1:] &= ENDS_WHITE[flat[:-1]]
            cut |= lone & (kind == SPACE) & ~(before & after)
            cut[1:] |= (lone & (kind == BREAK) & ~before & ~after)[:-1]
        begin = offsets[:-1][np.diff(offsets) > 0]
        cut[begin] = True
        starts = np.flatnonzero(cut)
        first = np.searchsorted(starts, offsets)
        bounds = np.append(starts, len(flat)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        if self.held > CACHE_BYTES:
            self._forget([c for c in distinct if c in self.chunks])
        new = [c for c in distinct if c not in self.chunks]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.chunks.__getitem__, distinct), np.int64, len(distinct))
        number = number[chunks.indices.to_numpy(zero_copy_only=False)] if len(distinct) else number
        lengths = self.at[number + 1] - self.at[number]
        ids = self.ids[gather_runs(self.at[number], lengths)]
        sums = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        return ids, sums[first]

    def _mixed(self, texts: pa.Array, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, rest = np.flatnonzero(apart), np.flatnonzero(~apart)
        ids, at = self.encode(texts.take(pa.array(rest))) if len(rest) else (np.empty(0, np.uint32), np.zeros(1, np.int64))
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(apart)
        for k, r in enumerate(rest):
            parts[r] = ids[at[k] : at[k + 1]]
        for r in rows:
            parts[r] = np.asarray(self._whole(texts[int(r)].as_py()), np.uint32)
        offsets = np.zeros(len(apart) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return np.concatenate(parts) if parts else ids, offsets


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """This process's encoder for the file; it lives on between tasks."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]
