"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents stand in id order as one stream of tokens.  Windows of at most
``size`` tokens are cut at document ends, sentence ends, or, where neither is
near, every few tokens.  With p(j) the stream position of cut j,

    f(j) = penalty(j) + min over i, p(j) - p(i) <= size, of f(i) + padding(p(j) - p(i))

where padding is size - length, and zero where the length is a power of two.
The first part is a sliding-window minimum of f(i) + p(i), kept in a monotone
queue; the second adds one lookup for each power of two.  So the cost is linear
in the number of cuts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.encoding import encoder
from tesserae.llm.textcore import gather_runs, text_blocks, tidied
from tesserae.llm.token_files import in_id_order, with_end

#: Padded tokens that one cut is worth: at a sentence's end, elsewhere in a document; and a window's own cost, which breaks ties.
SENTENCE_CUT, HARD_CUT, WINDOW = 2.0, 16.0, 0.01
#: Where no document or sentence ends for longer than this, cuts are allowed every HARD_STEP tokens; a smaller window lowers both.
HARD_GAP, HARD_STEP = 128, 32
#: Tokens planned together, and the windows at their end that are planned again with what follows.
BLOCK_TOKENS, AGAIN = 1_000_000, 8
#: Bytes of text encoded at once.
BLOCK_BYTES = 8 << 20


def sentence_ends(tokenizer) -> np.ndarray:
    """For each id, whether its token ends a sentence: it ends in . ! or ?, or holds a line end."""
    words = sorted(tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
    out = np.zeros(words[-1][1] + 1, bool)
    for w, i in words:
        out[i] = w.endswith((".", "!", "?")) or "Ċ" in w or "\n" in w
    return out


_sentence_ends: dict[str, np.ndarray] = {}


def cuts(n: int, doc_ends: np.ndarray, sentence: np.ndarray, size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which windows may end, ascending from 0 to n and at most ``size`` apart, and their penalties."""
    penalty = np.full(n + 1, np.inf, np.float32)
    penalty[sentence] = SENTENCE_CUT
    penalty[0] = penalty[doc_ends] = 0
    soft = np.flatnonzero(penalty < np.inf)
    gap = np.diff(soft)
    wide, step = gap > min(HARD_GAP, size), min(HARD_STEP, size)
    steps = (gap[wide] - 1) // step
    penalty[np.repeat(soft[:-1][wide], steps) + step * (1 + gather_runs(np.zeros(len(steps), np.int64), steps))] = HARD_CUT
    at = np.flatnonzero(penalty < np.inf)
    return at, penalty[at].astype(np.float64)


def plan(at: np.ndarray, penalty: np.ndarray, size: int) -> np.ndarray:
    """Indices of the chosen cuts, first 0 and last len(at) - 1, at the least total cost."""
    n = len(at)
    # for each cut, the cuts a power of two before it
    froms, tos = [], []
    for w in (1 << k for k in range(size.bit_length()) if 1 << k < size):
        k = np.searchsorted(at, at - w)
        hit = np.flatnonzero((at >= w) & (at[np.minimum(k, n - 1)] == at - w))
        froms.append(k[hit])
        tos.append(hit)
    froms, tos = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (froms, tos))
    order = np.argsort(tos, kind="stable")
    exact = froms[order].tolist()
    first = np.searchsorted(tos[order], np.arange(n + 1)).tolist()
    p, base = at.tolist(), (penalty + WINDOW).tolist()
    f, back = [0.0] * n, [0] * n
    # the queue: cuts in order with ascending f + p; its head is the best start within reach
    queue, keys, head = [0], [0.0], 0
    for j in range(1, n):
        pj = p[j]
        while p[queue[head]] < pj - size:
            head += 1
        i = queue[head]
        best = keys[head] + size - pj
        a, b = first[j], first[j + 1]
        while a < b:
            k = exact[a]
            if f[k] < best:
                best, i = f[k], k
            a += 1
        f[j] = best = best + base[j]
        back[j] = i
        best += pj
        while len(keys) > head and keys[-1] > best:
            keys.pop()
            queue.pop()
        keys.append(best)
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return np.asarray(out[::-1])


@dataclass
class Stream:
    """Tokens that wait to be packed: whole documents, but for ``lead`` ids of the first that are packed already."""

    ids: np.ndarray
    at: np.ndarray  # n_docs + 1 offsets into ids
    docs: pa.Array
    lead: int = 0


def pack_stream(s: Stream, ends: np.ndarray, size: int, last: bool) -> tuple[dict[str, np.ndarray], Stream]:
    """Pieces of the stream's windows, and the stream that is left: nothing if ``last``, else the last windows, to be planned again with more.

    ends: sentence_ends().
    """
    ids, at, n = s.ids, s.at, len(s.ids)
    where, penalty = cuts(n, at[1:], np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1, size)
    windows = where[plan(where, penalty, size)]
    if not last:
        windows = windows[: max(1, np.searchsorted(windows, n - AGAIN * size, "right"))]
    done = int(windows[-1])
    marks = np.zeros(done + 1, bool)
    marks[windows] = marks[at[at <= done]] = True
    bounds = np.flatnonzero(marks)
    a, b = bounds[:-1], bounds[1:]
    doc = np.searchsorted(at, a, "right") - 1
    seq = np.searchsorted(windows, a, "right") - 1
    data = memoryview(np.ascontiguousarray(ids.astype("<u4", copy=False)).view(np.uint8))
    crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
    tokens, before = np.diff(at), np.zeros(len(at) - 1, np.int64)
    if len(tokens):
        before[0] = s.lead
    pieces = {"doc": doc, "start": a - at[doc] + before[doc], "length": b - a, "crc": np.asarray(crc, np.int64), "tokens": (tokens + before)[doc], "seq": seq, "offset": a - windows[seq], "windows": np.asarray([len(windows) - 1])}
    first = int(np.searchsorted(at, done, "right")) - 1  # the document that holds what comes next
    if first >= len(s.docs):
        return pieces, Stream(ids[:0], np.zeros(1, np.int64), s.docs.slice(0, 0))
    return pieces, Stream(ids[done:], np.append(0, at[first + 1 :] - done), s.docs.slice(first), int(done - at[first] + before[first]))


SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` tokens.

    A document is its token ids and then ``end_id``.  Sequences hold whole
    runs of the stream of documents in id order, within ranges of ids, one a
    task; their numbers grow with the ids, and the last of each range may be
    short, so padding grows by at most one window a task.  Within a range tokens
    are planned a million at a time, and the last AGAIN windows of each block
    again with the next.  Windows end at a document's end (free), a sentence's
    end (SENTENCE_CUT), or, where neither comes for HARD_GAP tokens, at every
    HARD_STEP-th (HARD_CUT); a ``size`` below these lowers both to itself.

    Ids may be of any type that sorts, and keep it.  Null texts are empty
    documents of the end id alone; null ids come first; equal ids are ordered by
    their texts' hash and repeated rows are packed each; an empty table gives no
    rows; other columns are ignored.
    """
    if size < 1:
        raise ValueError("size must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        if tokenizer_path not in _sentence_ends:
            _sentence_ends[tokenizer_path] = sentence_ends(enc.tokenizer)
        ends = _sentence_ends[tokenizer_path]
        sequence = TaskContext.get().partitionId() << 32
        rest: Stream | None = None

        def out(last: bool) -> pa.RecordBatch:
            nonlocal sequence, rest
            held, (p, rest) = rest.docs, pack_stream(rest, ends, size, last)
            columns = [held.take(pa.array(p["doc"])), *(pa.array(p[k], pa.int64()) for k in ("start", "length", "crc", "tokens")), pa.array(p["seq"] + sequence, pa.int64()), pa.array(p["offset"], pa.int64())]
            sequence += int(p["windows"][0])
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            texts = b.column(1)
            for i, j in text_blocks(texts, BLOCK_BYTES):
                ids, at = with_end(*enc.encode(texts.slice(i, j - i)), end_id)
                own = b.column(0).slice(i, j - i)
                rest = Stream(ids, at, own) if rest is None else Stream(np.concatenate([rest.ids, ids]), np.append(rest.at, at[1:] + rest.at[-1]), pa.concat_arrays([rest.docs, own]), rest.lead)
                if len(rest.ids) >= max(BLOCK_TOKENS, 4 * AGAIN * size):
                    yield out(False)
        if rest is not None and len(rest.ids):
            yield out(True)

    packed = in_id_order(docs, id_col, text_col).mapInArrow(tidied(run), SCHEMA.format(docs.schema[id_col].dataType.simpleString()))
    return packed if id_col == "doc_id" else packed.withColumnRenamed("doc_id", id_col)
