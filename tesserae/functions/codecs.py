"""Text forms of dates and numbers that sort as their values do, and binary helpers."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns by resolution, for Spark and for Python.
RESOLUTIONS = {"year": ("yyyy", "%Y"), "month": ("yyyyMM", "%Y%m"), "day": ("yyyyMMdd", "%Y%m%d"), "hour": ("yyyyMMddHH", "%Y%m%d%H"), "minute": ("yyyyMMddHHmm", "%Y%m%d%H%M"), "second": ("yyyyMMddHHmmss", "%Y%m%d%H%M%S"), "millisecond": ("yyyyMMddHHmmssSSS", "%Y%m%d%H%M%S%f")}


def date_string(ts: Column, resolution: str) -> Column:
    return F.date_format(ts, RESOLUTIONS[resolution][0])


def date_text(ts: datetime, resolution: str) -> str:
    text = ts.strftime(RESOLUTIONS[resolution][1])
    return text[:-3] if resolution == "millisecond" else text


def string_date(text: Column) -> Column:
    """The first instant of a date string, its resolution told by its length."""
    by_length = {len(p): p for p, _ in RESOLUTIONS.values()}
    out = F.lit(None).cast("timestamp")
    for n, p in by_length.items():
        out = F.when(F.length(text) == n, F.try_to_timestamp(text, F.lit(p))).otherwise(out)
    return out


def rounded(ts: Column, resolution: str) -> Column:
    return F.date_trunc(resolution, ts)


#: Characters of a long in base 36, after the sign.
WIDTH = 13


def long_string(x: Column) -> Column:
    """A long as one sign character and 13 digits in base 36; the order of strings is that of values.

    Negative values are offset by the least long, so they too have 13 digits.
    """
    least = F.lit(-(1 << 63))
    digits = F.lower(F.lpad(F.conv(F.when(x < 0, x - least).otherwise(x).cast("string"), 10, 36), WIDTH, "0"))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("0")), digits)


def string_long(s: Column) -> Column:
    value = F.conv(F.substring(s, 2, WIDTH), 36, 10).cast("decimal(20,0)")
    return F.when(F.startswith(s, F.lit("-")), value - F.lit(str(1 << 63)).cast("decimal(20,0)")).otherwise(value).cast("long")


def prefix_coded(x: Column, shift: int = 0) -> Column:
    """A long, less its low ``shift`` bits, as a sign-flipped hexadecimal string led by the shift."""
    flipped = F.shiftrightunsigned(x.cast("long").bitwiseXOR(F.lit(-(1 << 63))), shift)
    return F.concat(F.lit(f"{shift:02x}:"), F.lpad(F.hex(flipped), 16, "0"))


def prefix_decoded(term: Column) -> Column:
    """The long of a ``prefix_coded`` term, its missing low bits zero; other strings give null."""
    bits = F.conv(F.substring(term, 4, 16), 16, -10).cast("long")
    shift = F.conv(F.substring(term, 1, 2), 16, 10).cast("int")
    return F.when(term.rlike("^[0-9a-f]{2}:[0-9A-F]{16}$"), F.call_function("shiftleft", bits, shift).bitwiseXOR(F.lit(-(1 << 63))))


def trie_terms(x: Column, step: int = 4) -> Column:
    """Terms of every precision of a long, the full one first."""
    return F.array(*[prefix_coded(x, s) for s in range(0, 64, step)])


def sortable_long(x: Column) -> Column:
    """A double as a long of the same order; -0.0 and 0.0 are told apart, and a NaN is above all."""
    bits = _ieee(x)
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _ieee(x: Column) -> Column:
    """The bits of a double as a long, by its sign, exponent and mantissa."""
    size = F.abs(x)
    # the exponent by log2 may be one off next to a power of two
    guess = F.floor(F.log2(size))
    e = F.greatest(guess + F.when(F.pow(F.lit(2.0), guess + 1) <= size, 1).when(F.pow(F.lit(2.0), guess) > size, -1).otherwise(0), F.lit(-1022))
    # in two steps, since 2 ** 1074 is no double
    scaled = size * F.pow(F.lit(2.0), F.floor((52 - e) / 2)) * F.pow(F.lit(2.0), 52 - e - F.floor((52 - e) / 2))
    whole = scaled.cast("long") + F.when(size >= F.lit(2.0**-1022), F.shiftleft((e + 1022).cast("long"), 52)).otherwise(F.lit(0).cast("long"))
    bits = F.when(size == 0, F.lit(0).cast("long")).when(F.isnan(x), F.lit(0x7FF8 << 48)).when(size == float("inf"), F.lit(0x7FF0 << 48)).otherwise(whole)
    negative = (x < 0) | (x.cast("string") == "-0.0")
    return F.when(negative, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)


def covering(low: int, high: int, step: int = 4, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, first, last): the fewest ranges of prefixes, of precisions ``step`` bits apart, that make up low .. high; not negative."""
    out, shift = [], 0
    while low <= high:
        first, last = -(-low >> step), (high + 1 >> step) - 1  # whole blocks of the next precision
        if first > last or shift + step >= bits:
            return [*out, (shift, low, high)]
        if low < first << step:
            out.append((shift, low, (first << step) - 1))
        if last + 1 << step <= high:
            out.append((shift, last + 1 << step, high))
        low, high, shift = first, last, shift + step
    return out


def trie_range(low: int | None, high: int | None, step: int = 4) -> list[tuple[str, str]]:
    """(first, last) terms of ``prefix_coded`` whose ranges make up the longs low .. high, ends included."""
    flip = 1 << 63
    a, b = -flip if low is None else max(low, -flip), flip - 1 if high is None else min(high, flip - 1)
    return [(f"{s:02x}:{x:016X}", f"{s:02x}:{y:016X}") for s, x, y in covering(a + flip, b + flip, step)] if a <= b else []


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; beyond ``most`` null."""
    if most is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


def compress(data: Column) -> Column:
    """zlib, batch by batch."""
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        import zlib

        return s.map(lambda b: None if b is None else zlib.compress(bytes(b), 9))

    return run(data)


def decompress(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        import zlib

        return s.map(lambda b: None if b is None else zlib.decompress(bytes(b)))

    return run(data)
