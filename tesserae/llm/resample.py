"""Quality selection by importance resampling over hashed n-grams.

Two generative bag-of-n-gram models are counted, one over the target texts and
one over all raw texts.  A document's log weight is the sum over its hashed
word unigrams and bigrams of log p_target - log p_raw.  Adding Gumbel noise to
the log weights and keeping the k largest keys samples k documents without
replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import stored
from tesserae.llm.textcore import MIX, hash_words, mix, text_blocks, tidied, words_of

BUCKETS = 1 << 16
#: Labelled target documents used at most, a bound on what is broadcast; chosen by a hash of the id.
TARGET_ROWS = 200_000
#: Bins of one round of the search for the k-th largest key, and rows that end it.
BINS, FEW = 4096, 20_000


def hashed_ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's unigrams and bigrams, and the text each belongs to."""
    w = words_of(texts)
    if not len(w.starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, words = w.codes()
    h = hash_words(words)[codes]
    doc = w.doc_of()
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * MIX + h[1:])
    same = doc[:-1] == doc[1:]
    grams = np.concatenate([h, pair[same]])
    return (grams & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([doc, doc[:-1][same]])


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw by bucket.

    Both models are smoothed towards the raw one, so a bucket that the target
    never saw counts in proportion to how often the raw texts have it.
    """
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    p_target = (target + smooth * len(raw) * p_raw) / (target.sum() + smooth * len(raw))
    return np.log(p_target) - np.log(p_raw)


def ngram_counts(docs: DataFrame, targets: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Bucket counts over target and all texts, and the numbers of target and of all documents."""
    flagged = docs.join(F.broadcast(targets.withColumn("hit", F.lit(True))), "id", "left").select("t", F.coalesce("hit", F.lit(False)).alias("hit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            hit = b.column(1).to_numpy(zero_copy_only=False)
            raw[-1] += len(hit)
            target[-1] += hit.sum()
            for i, j in text_blocks(b.column(0)):
                grams, doc = hashed_ngrams(b.column(0).slice(i, j - i))
                raw[:-1] += np.bincount(grams, minlength=BUCKETS)
                target[:-1] += np.bincount(grams[hit[i:j][doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    sums = flagged.mapInArrow(tidied(run), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in sums.collect():  # BUCKETS + 1 rows, whatever the corpus
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return target[:-1], raw[:-1], int(target[-1]), int(raw[-1])


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of column key (no nulls), by rounds of histograms; minus infinity beyond the rows."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    part, above = keys, 0
    while n > FEW and lo < hi:
        width = (hi - lo) / BINS
        if width <= abs(hi) * 1e-15 or not width:
            break
        bin_of = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1))
        found = sorted(((r["b"], r["n"], r["x"], r["y"]) for r in part.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("x"), F.max("key").alias("y")).collect()), reverse=True)
        for _, count, x, y in found:
            if above + count >= k:
                n, lo, hi = count, x, y
                break
            above += count
        part = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
    if lo == hi:
        return lo
    return part.orderBy(F.desc("key")).limit(k - above).agg(F.min("key")).first()[0]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, noise: float = 1.0, seed: int = 42, target_rows: int = TARGET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_weight, sample_key, kept) per row.

    ``labels`` has (id, quality) and may have toxic: texts of quality 1 that are
    not toxic are the target; a null toxic, or no such column, is not toxic, and
    an id that any of its labels calls toxic is.  At most ``target_rows`` target
    documents, chosen by a hash of the id, are used, a bound on what is
    broadcast; the raw model counts all documents.  k is the sample's size; None
    takes as many documents as the labels call good in this sense, in
    proportion.  The Gumbel noise is a function of seed, id and text, so the
    sample repeats exactly; rows alike in both are kept or left together, and
    ties at the k-th key are all kept.  Null and empty texts have weight zero,
    as in both models no n-gram tells them apart; null ids stay; labels with a
    null id or quality, or of no document, count nothing; without target texts
    all weights are zero; an empty table gives no rows; other columns are
    ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    marked = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("q"), toxic.alias("toxic")).where("id is not null")
    bad = marked.where("toxic").select("id").distinct().withColumn("bad", F.lit(True))
    votes = marked.where("q is not null").join(bad, "id", "left").select("id", (F.col("q").eqNullSafe(1) & F.col("bad").isNull()).alias("good"))
    good, voted = votes.agg(F.sum(F.col("good").cast("long")), F.count("*")).first()
    targets = votes.where("good").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(target_rows)
    target, raw, n_target, n_docs = ngram_counts(rows, targets)
    ratio = log_ratio(target, raw) if target.sum() else np.zeros(BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    if k is None:
        k = -(-n_docs * (good or 0) // voted) if voted else n_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            texts = b.column(1)
            words, logs = [np.empty(0, np.int64)], [np.empty(0)]
            for i, j in text_blocks(texts):
                part = texts.slice(i, j - i)
                grams, doc = hashed_ngrams(part)
                logs.append(np.bincount(doc, weights[grams], j - i))
                words.append(words_of(part).counts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.concatenate(words)), pa.array(np.concatenate(logs))], ["id", "h", "n_words", "log_weight"])

    hashed = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "t"))
    scored = hashed.mapInArrow(tidied(run), f"id {kind}, h long, n_words long, log_weight double")
    uniform = (F.shiftrightunsigned("h", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = stored(scored.withColumn("key", F.col("log_weight") - noise * F.log(-F.log(uniform))), "resample")
    cut = kth_largest(keyed, k)
    return keyed.select(F.col("id").alias(id_col), "n_words", "log_weight", F.col("key").alias("sample_key"), (F.col("key") >= F.lit(cut)).alias("kept"))
