"""The scoring model as column factories and their driver-side twins.

A subclass overrides any factor; each returns a Column for what varies by row
and a float for what is known when the query is bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range of a norm byte: a 3-bit mantissa and a 5-bit exponent.
LEAST_NORM, MOST_NORM = 2.0**-33 * 5, 7516192768.0


class Similarity:
    """TF-IDF with length norms of one byte."""

    def tf(self, freq: Column) -> Column:
        return F.sqrt(freq)

    def idf(self, doc_freq: int, max_doc: int) -> float:
        return math.log(max_doc / (doc_freq + 1)) + 1 if max_doc else 1.0

    def length_norm(self, n_tokens: Column) -> Column:
        return F.lit(1.0) / F.sqrt(n_tokens)

    def norm(self, n_tokens: Column, boost: Column | float = 1.0) -> Column:
        """The decoded norm byte of a field of ``n_tokens`` tokens; no tokens: the largest norm of all."""
        x = self.length_norm(n_tokens.cast("double")) * boost
        return F.when(n_tokens > 0, decoded_norm(x)).otherwise(F.lit(MOST_NORM))

    def query_norm(self, sum_of_squares: float) -> float:
        if not sum_of_squares or math.isinf(sum_of_squares) or math.isnan(sum_of_squares):
            return 1.0
        return 1.0 / math.sqrt(sum_of_squares)

    def coord(self, overlap: Column, most: int) -> Column:
        return overlap / F.lit(most)

    def sloppy_freq(self, distance: Column) -> Column:
        return F.lit(1.0) / (distance + 1)

    def payload_score(self, payload: Column) -> Column:
        """What a token's payload counts in payload queries."""
        return payload


def decoded_norm(x: Column) -> Column:
    """x with its exponent and the top two bits of its mantissa, within a norm byte's range; not above zero: 0."""
    # the exponent by log2 may be one too high or low next to a power of two, so it is set right
    e0 = F.floor(F.log2(x))
    e = e0 + F.when(F.pow(F.lit(2.0), e0 + 1) <= x, 1).when(F.pow(F.lit(2.0), e0) > x, -1).otherwise(0)
    p = F.pow(F.lit(2.0), e)
    near = p * F.floor(4 * x / p) / 4
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.least(F.greatest(near, F.lit(LEAST_NORM)), F.lit(MOST_NORM)))
