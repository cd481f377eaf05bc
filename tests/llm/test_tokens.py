import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tesserae.llm.encoding import PIECE, BatchEncoder, default_tokenizer_path
from tesserae.llm import packing
from tesserae.llm.packing import HARD_CUT, SENTENCE_CUT, WINDOW, cuts, pack_documents, plan
from tesserae.llm.shared import fresh_dir
from tesserae.llm.token_counts import CountingTransducer, states_before, token_counts, FRESH, IDLE, NEXT
from tesserae.llm.token_files import open_token_files, write_token_files
from tests.llm.data import SF, awkward, empty

PATH = default_tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = list("abrevlstmd'' \n\t  1!é½.　ß_") + ["<|endoftext|>", "'re", "'ll", "漢", "\x1c", "\x85", "  ", "🙂"]


def strings(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(n)] + [None, "", " ", "'r", "x'l", "x" * 3000, " " * 700]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    texts = strings(4000, 1) + [f"a{chr(c)}{chr(c)}b1 {chr(c)}'s \n{chr(c)}1" for c in range(0x250)]
    enc = BatchEncoder(PATH)
    for part in (texts[:50], texts):
        ids, at = enc.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(t) for t in part]
    assert PIECE.findall(" don't") == [" don", "'t"]


def test_transducer_equals_the_library():
    texts = strings(6000, 2)
    assert CountingTransducer(PATH).counts(texts).tolist() == [len(ids_of(t)) for t in texts]


def test_chunk_maps_compose_to_a_plain_run():
    classes = np.random.default_rng(3).integers(0, IDLE, 5000).astype(np.uint8)
    want, s = [], FRESH
    for c in classes:
        want.append(s)
        s = NEXT[s, c]
    assert states_before(classes).tolist() == [*want, s]


def test_counts_over_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: (len(r["text"].encode()), len(ids_of(r["text"]))) for r in docs.collect()}
    got = token_counts(docs, PATH).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_optimal(seed):
    r = random.Random(seed)
    size = 16
    at = [0]
    for _ in range(40):
        at.append(at[-1] + r.randrange(1, 9))
    at = np.asarray(at)
    penalty = np.asarray([r.choice([0, SENTENCE_CUT, HARD_CUT]) for _ in at])

    def cost(a, b):
        n = at[b] - at[a]
        return penalty[b] + WINDOW + (0 if n & (n - 1) == 0 else size - n)

    best = [0.0] + [float("inf")] * (len(at) - 1)
    for b in range(1, len(at)):
        best[b] = min(best[a] + cost(a, b) for a in range(b) if at[b] - at[a] <= size)
    chosen = plan(at, penalty, size)
    assert sum(cost(a, b) for a, b in zip(chosen, chosen[1:])) == pytest.approx(best[-1])


def test_cuts_leave_no_gap_wider_than_a_window():
    at, _ = cuts(5000, np.asarray([4000, 5000]), np.asarray([10]))
    assert np.diff(at).max() <= 128 and at[0] == 0 and at[-1] == 5000


def check_pieces(rows, want, size=1024):
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    padded = used = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
        used += end
        padded += end if end & (end - 1) == 0 else size
    for i, ids in want.items():
        end = 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(ids)
            end += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : end], "<u4").tobytes())
        assert end == len(ids)
    return padded / used - 1


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: [*ids_of(r["text"]), 0] for r in docs.collect()}
    assert check_pieces(pack_documents(docs, PATH).collect(), want) < 0.05


@pytest.mark.parametrize("size", [1, 2, 16, 64, 100, 127, 128])
def test_small_windows(size):
    r = random.Random(size)
    for _ in range(20):
        n = r.randrange(1, 600)
        ends = np.unique([r.randrange(1, n + 1) for _ in range(r.randrange(4))] + [n])
        sentence = np.asarray(sorted({r.randrange(1, n + 1) for _ in range(r.randrange(8))}), np.int64)
        at, penalty = cuts(n, ends, sentence, size)
        chosen = at[plan(at, penalty, size)]
        assert chosen[0] == 0 and chosen[-1] == n and np.diff(chosen).min() > 0 and np.diff(chosen).max() <= size


def test_blocks_join_without_short_windows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: [*ids_of(r["text"]), 0] for r in docs.collect()}
    for size in (64, 1024):
        check_pieces(pack_documents(docs, PATH, size).collect(), want, size)
    # in this process: many small blocks pack about as well as one
    ids = [np.asarray(v, np.uint32) for _, v in sorted(want.items())]
    ends = packing.sentence_ends(LIBRARY)
    rest, padding, pieces = None, 0, []
    padded = lambda p: sum(0 if n & (n - 1) == 0 else 1024 - n for n in np.bincount(p["seq"], p["length"]).astype(int).tolist())
    whole = packing.pack_stream(packing.Stream(np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids])), pa.array(range(len(ids)))), ends, 1024, True)[0]
    for k, own in enumerate(ids):
        at, doc = np.asarray([0, len(own)]), pa.array([k])
        rest = packing.Stream(own, at, doc) if rest is None else packing.Stream(np.concatenate([rest.ids, own]), np.append(rest.at, at[1:] + rest.at[-1]), pa.concat_arrays([rest.docs, doc]), rest.lead)
        if len(rest.ids) > 40_000 or k == len(ids) - 1:
            docs_of = rest.docs
            p, rest = packing.pack_stream(rest, ends, 1024, k == len(ids) - 1)
            pieces += zip(docs_of.take(pa.array(p["doc"])).to_pylist(), p["start"].tolist(), p["length"].tolist(), p["tokens"].tolist())
            padding += padded(p)
    end = {}
    for k, start, length, tokens in pieces:
        assert start == end.get(k, 0) and tokens == len(ids[k])
        end[k] = start + length
    assert end == {k: len(v) for k, v in enumerate(ids)} and not len(rest.ids)
    assert padding <= padded(whole) + 1024


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "none")], "doc_id string, text string")
    assert [r["doc_id"] for r in sorted(pack_documents(docs.coalesce(1), PATH).collect(), key=lambda r: (r["sequence_id"], r["offset"]))] == [None, "a", "b"]
    with pytest.raises(ValueError):
        write_token_files(docs, PATH, fresh_dir(spark, "tokens"))


def test_token_files_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: [*ids_of(r["text"]), 0] for r in docs.collect()}
    path = fresh_dir(spark, "tokens")
    write_token_files(docs, PATH, path)
    files = open_token_files(path)
    start = 0
    for r in sorted(files.documents(spark).collect(), key=lambda r: r["doc_id"]):
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: r["ids"] for r in files.ids(spark).collect()} == want


def test_edges(spark):
    docs = awkward(spark)
    n = docs.count()
    assert token_counts(docs, PATH).count() == n
    assert token_counts(docs, PATH).where("doc_id = 0").first()["n_tokens"] == 0
    pieces = pack_documents(docs, PATH).collect()
    total = sum(len(ids_of(r["text"])) + 1 for r in docs.collect())
    assert sum(r["length"] for r in pieces) == total
    files = write_token_files(docs, PATH, fresh_dir(spark, "tokens"))
    back = files.documents(spark).collect()
    assert len(back) == n and sum(r["n_tokens"] for r in back) == total and sum(r["doc_id"] is None for r in back) == 2
    assert token_counts(empty(spark), PATH).count() == pack_documents(empty(spark), PATH).count() == 0
    assert write_token_files(empty(spark), PATH, fresh_dir(spark, "tokens")).documents(spark).count() == 0
