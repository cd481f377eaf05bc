"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the characters that divide words.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent words of four languages.
STOP_WORDS = tuple(
    "the and of to in is that it for on with as was be by at this are from or an a "
    "de la que el en los las un una por con para del se es y al lo "
    "et le les des du une est pas pour dans qui sur au avec ce il elle "
    "der die das und ist nicht ein eine von mit den zu dem auf im als auch".split()
)


@dataclass(frozen=True)
class Rule:
    """A text passes when low <= metric <= high; a metric that is null (nothing to measure) passes."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.
RULES = (
    Rule("mean_word_length", 2.0, 12.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_share", low=0.02),
    Rule("dup_line_share", high=0.5),
)
#: Stop words are asked for only in texts of this many words.
STOP_WORD_TEXT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeated_window_words(w: Column, size: int = 5) -> Column:
    """Words of an array that lie in a window of ``size`` words found twice or more."""

    def covered(hashes: Column) -> Column:
        def count(order: Column) -> Column:
            again = F.filter(order, lambda x, j: (F.get(order, j - 1)["h"] == x["h"]) | (F.get(order, j + 1)["h"] == x["h"]))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(s, j + 1) - x, F.lit(size)))), F.lit(0), lambda a, b: a + b))

        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # most texts repeat nothing, and need no sort
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(order, count))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < size, F.lit(0)).otherwise(let(hashed, lambda h: let(windows(h), covered)))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """Whether every rule passes."""
    ok = F.lit(True)
    for r in rules:
        m = F.col(r.metric)
        if r.low is not None:
            ok = ok & F.coalesce(m >= r.low, F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(m <= r.high, F.lit(True))
    return ok


def quality_metrics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and every metric, by built-in functions alone."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(keep)], text.alias("__text"))
    base = base.withColumns({"__words": words(F.col("__text")), "__lines": F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)})
    one = base.select(
        *[F.col(f"__{k}") for k in range(len(keep))],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: F.translate(F.lower(w), ".,;:!?", "").isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    n = F.col("n_words")
    some = one.withColumns(
        {
            "base_failed": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
            "mean_word_length": F.when(n > 0, F.col("word_chars") / n),
            "symbols_per_word": F.when(n > 0, F.col("n_symbols") / n),
            "stop_word_share": F.when(n >= STOP_WORD_TEXT, F.col("n_stop_words") / n),
            "dup_line_share": F.when(F.col("__n_lines") > 0, F.col("n_dup_lines") / F.col("__n_lines")),
        }
    )
    return some.drop("__n_lines").withColumnsRenamed({f"__{k}": c for k, c in enumerate(keep)})


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per row.

    One projection, without a shuffle or a user function.  Null texts have no
    words and fail; so do texts of fewer than 10 words, and texts of which more
    than a fifth lies in repeated 5-word windows.  ``kept`` is false for these
    and for texts that break a rule.  Null ids and repeated rows stay as they
    are; an empty table gives no rows; other columns are ignored.
    """
    m = quality_metrics(docs, text_col, (id_col,))
    return m.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, as they are, in one projection and filter.

    Columns of ``docs`` named like a metric keep their own values.
    """
    row = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__source"))
    m = quality_metrics(row, "__source", ("__row",))
    return m.where(~F.col("base_failed") & verdict(rules)).select(*[F.col("__row")[c].alias(c) for c in docs.columns])
