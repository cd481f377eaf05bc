"""Filters and set operations over document ids."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans import ast as A
from tesserae.plans.search import DOC, Compiler, DocSet, View, matching


def span_positions(view: View, query: A.Span) -> DataFrame:
    """(doc_id, spans array<struct<s,e>>) of documents with any span."""
    c = Compiler(view, query)
    spans = c.spans(c.query)
    rows = c.frame()
    return matching(rows, F.size(spans) > 0).select(F.col(DOC).alias(view.schema.id_col), spans.alias("spans"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def one_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric difference: one aggregation over both sides."""
    k = a.columns[0]
    tagged = a.distinct().withColumn("__n", F.lit(1)).union(b.distinct().toDF(k).withColumn("__n", F.lit(1)))
    return tagged.groupBy(k).agg(F.sum("__n").alias("__n")).where("__n = 1").select(k)


def flipped(a: DataFrame, all_docs: DataFrame) -> DataFrame:
    return all_docs.join(a.distinct(), all_docs.columns[0], "left_anti")


def cardinality(a: DataFrame, name: str = "n") -> DataFrame:
    return a.agg(F.count("*").alias(name))


def counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both, either, only_a, only_b and one_of, counted in one aggregation."""
    k = a.columns[0]
    tagged = a.select(F.col(k).alias("k"), F.lit(1).alias("side")).union(b.select(F.col(b.columns[0]), F.lit(2)))
    seen = tagged.groupBy("k").agg(F.max((F.col("side") == 1).cast("int")).alias("x"), F.max((F.col("side") == 2).cast("int")).alias("y"))
    sides = seen.agg(F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("both"), F.count("*").alias("either"), F.count_if(F.col("y") == 0).alias("only_a"), F.count_if(F.col("x") == 0).alias("only_b"))
    return sides.withColumn("one_of", F.col("only_a") + F.col("only_b"))


class FilterCache:
    """Filters kept as tables of ids in a folder that all executors share, by the query's canonical text; the oldest go first.

    One cache belongs to one version of the documents: ``clear`` it, or make
    another, when they change.
    """

    def __init__(self, view: View, folder: str, most: int = 100):
        self.view, self.folder, self.most = view, folder.rstrip("/"), most
        self.kept: OrderedDict[str, tuple[str, bool]] = OrderedDict()

    def get(self, query: A.Query, spans: bool = False) -> DocSet:
        """The query's documents as a filter; with ``spans``, column ``spans`` of ``frame`` has their spans."""
        key = f"{type(query).__name__} {query}" + " with spans" * spans
        if key not in self.kept:
            found = span_positions(self.view, query) if spans else Compiler(self.view, query).hits().select(self.view.schema.id_col)
            path = f"{self.folder}/filter-{uuid.uuid4().hex}"
            found.write.parquet(path)
            self.kept[key] = (path, spans)
        self.kept.move_to_end(key)
        spark = self._session()
        while len(self.kept) > self.most:
            self._remove(self.kept.popitem(last=False)[1][0])
        return DocSet(key, spark.read.parquet(self.kept[key][0]))

    def clear(self) -> None:
        while self.kept:
            self._remove(self.kept.popitem()[1][0])

    @staticmethod
    def _session():
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession()

    def _remove(self, path: str) -> None:
        from tesserae.sources.index import Files

        Files(self._session(), path).delete("")


class TimeExceeded(RuntimeError):
    pass


def within_time(df: DataFrame, seconds: float) -> list:
    """The rows of a bounded result, or TimeExceeded: its jobs are cancelled when the time is over."""
    sc = df.sparkSession.sparkContext
    tag = f"within-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        rows = df.collect()
    except Exception as e:
        if over.is_set():
            raise TimeExceeded(f"not done within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    return rows
