"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.decontaminate import find_leaks
from tesserae.llm.encoding import default_tokenizer_path
from tesserae.llm.linededup import line_dedup
from tesserae.llm.packing import pack_documents
from tesserae.llm.pii import find_pii
from tesserae.llm.quality import RULES, STOP_WORD_TEXT, STOP_WORDS, quality_rules
from tesserae.llm.resample import resample
from tesserae.llm.shared import fresh_dir
from tesserae.llm.simhash import simhash_groups
from tesserae.llm.substrings import repeated_passages
from tesserae.llm.token_counts import token_counts
from tesserae.llm.token_files import write_token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, keep_first=False)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_tokenizer_path())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer_path())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_token_files(table(spark, sf_dir, "documents"), default_tokenizer_path(), fresh_dir(spark, "tokens")).documents(spark)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_neardup, op2_line_dedup, op3_quality_rules, op4_importance_resampling, op5_substring_dedup, op6_decontamination, op7_token_counts, op8_packing, op9_token_files, op10_pii)
}

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line,
        translate(trim(ls[i], {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
bad AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(bad.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad USING (key) GROUP BY doc_id
"""


def _verdict_sql() -> str:
    value = {
        "mean_word_length": "CASE WHEN n_words > 0 THEN word_chars / n_words END",
        "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols / n_words END",
        "stop_word_share": f"CASE WHEN n_words >= {STOP_WORD_TEXT} THEN n_stop / n_words END",
        "dup_line_share": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines END",
    }
    tests = [f"coalesce({value[r.metric]} >= {r.low}, true)" for r in RULES if r.low is not None]
    tests += [f"coalesce({value[r.metric]} <= {r.high}, true)" for r in RULES if r.high is not None]
    return " AND ".join(tests)


STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

RULE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, {WHITE})) > 0) AS ls FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win FROM d, unnest(range(1, len(ws) - 3)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM w) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM again, unnest(range(i, i + 5)) AS u(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: list_contains([{STOP_SQL}], translate(lower(x), '.,;:!?', ''))))::BIGINT AS n_stop
      FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_verdict_sql()} AS kept
FROM b
"""

SQL: dict[str, str] = {"op2_line_dedup": LINE_SQL, "op3_quality_rules": RULE_SQL}
