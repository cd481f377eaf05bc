"""How the columns of a document table are indexed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from tesserae.functions.analysis import KEYWORD, SIMPLE, Analyzer, numeric


@dataclass(frozen=True)
class FieldSpec:
    """One searchable field: its column, analyzer, and what is kept of it.

    ``norms`` off scores every length alike; ``freqs`` off keeps neither counts
    nor positions, so phrases cannot match; ``boost`` multiplies the norm;
    ``repeated`` columns are arrays of values; ``payload`` gives each token a number
    that payload queries read.
    """

    column: str
    analyzer: Analyzer = SIMPLE
    norms: bool = True
    freqs: bool = True
    boost: float = 1.0
    repeated: bool = False
    #: A token's payload score as a function of the token (fields term and pos); None: no payloads.
    payload: Callable[[Column], Column] | None = None
    #: Bits between precisions of a numeric field's terms; None: no numeric field.
    trie_step: int | None = None


def keyword_field(column: str) -> FieldSpec:
    return FieldSpec(column, KEYWORD, norms=False, freqs=False)


def numeric_field(column: str, step: int = 4) -> FieldSpec:
    """A column of whole numbers as terms of every precision, so that a written index finds a range by few runs of terms."""
    return FieldSpec(column, numeric(step), norms=False, freqs=False, trie_step=step)


@dataclass(frozen=True)
class Schema:
    id_col: str = "doc_id"
    fields: dict[str, FieldSpec] = field(default_factory=dict)
    boost_col: str | None = None
