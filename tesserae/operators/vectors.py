"""Term vectors: a document's terms with their counts and positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.analysis import Analyzer
from tesserae.plans.search import DOC, HERE, ScanView, in_terms


def term_vectors(view: ScanView, field: str, docs: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, entries array<struct<term, freq, positions>>), most frequent first and then by term."""
    entry = lambda term, own: F.struct((-F.size(own).cast("long")).alias("k"), term.alias("term"), F.transform(own, lambda t: t["pos"]).alias("positions"))
    if isinstance(view, ScanView):
        # a document's tokens stand in one row, so its entries are made and sorted there
        rows = view.docs if docs is None else view.docs.where(docs(F.col(view.schema.id_col)))
        e = F.sort_array(in_terms(view.tokens(field), entry))
        # no test passes below a projection that is not deterministic, else each text would be analyzed once more for it
        v = rows.select(F.col(view.schema.id_col).alias(DOC), _entries(e).alias("entries"), F.spark_partition_id().alias(HERE))
        return v.where((F.size("entries") > 0) & (F.col(HERE) >= 0)).select(F.col(DOC).alias(view.schema.id_col), "entries")
    p = view.postings(field)
    if docs is not None:
        p = p.where(docs(F.col(DOC)))  # the id is a grouping key, so the filter reaches the scan
    v = p.groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct((-F.col("tf")).alias("k"), "term", "positions"))).alias("e"))
    return v.select(F.col(DOC).alias(view.schema.id_col), _entries(F.col("e")).alias("entries"))


def _entries(e: Column) -> Column:
    return F.transform(e, lambda x: F.struct(x["term"].alias("term"), (-x["k"]).alias("freq"), x["positions"].alias("positions")))


def by_position(vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, terms): the terms of each position."""
    e = vectors.select(id_col, F.explode("entries").alias("e")).select(id_col, F.explode("e.positions").alias("pos"), F.col("e.term").alias("term"))
    return e.groupBy(id_col, "pos").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def query_vector(spark, text: str, analyzer: Analyzer) -> DataFrame:
    """(term, freq) of a query string."""
    one = spark.createDataFrame([(text,)], "text string").select(F.explode(analyzer(F.col("text"))).alias("t"))
    return one.groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("freq"))
