"""Streams: stored queries over arriving documents, near-real-time indexing, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.similarity import Similarity
from tesserae.plans import ast as A
from tesserae.plans.search import DOC, Compiler, Leaf, ScanView, matching
from tesserae.schema import Schema


class OneDocumentView(ScanView):
    """Each document as an index of its own: one document, in which every term that stands is in one."""

    def doc_freqs(self, leaves: list[Leaf], sim: Similarity) -> tuple[list[int], int]:
        return [1] * len(leaves), 1


def match_stored(docs: DataFrame, schema: Schema, queries: dict[str, A.Query]) -> DataFrame:
    """(query, doc_id, score) of every stored query that a document matches.

    Each query is an expression over the document's row, all over the same one,
    so this is one narrow projection that reads and analyzes a document once and
    keeps no state: it runs alike over a table and a stream.
    """
    if not queries:
        return docs.sparkSession.createDataFrame([], f"query string, {schema.id_col} long, score double")
    c = Compiler(OneDocumentView(docs, schema), *[next(iter(queries.values())), None, *list(queries.values())[1:]])
    tests = []
    for name, q in zip(queries, c.queries):
        h = c.hit(q, c.sim.query_norm(c.squares(q)))
        tests.append(F.when(h.match, F.struct(F.lit(name).alias("query"), F.round(h.score, 6).alias("score"))))
    found = F.array_compact(F.array(*tests))
    rows = matching(c.frame(), F.size(found) > 0).select(F.col(DOC).alias(schema.id_col), F.explode(found).alias("x"))
    return rows.select("x.query", schema.id_col, "x.score")


def index_stream(docs: DataFrame, writer, checkpoint: str, on_batch: Callable[[int], None] | None = None):
    """Adds each batch of a stream to an index writer and commits; readers see it from then on.

    A batch that runs again after a failure is known by the commit's user data
    and is not added twice.
    """

    def put(batch: DataFrame, n: int) -> None:
        if int(writer.base.user_data.get("batch", "-1")) < n:
            writer.rollback()
            writer.add(batch)
            writer.commit({"batch": str(n)})
        if on_batch:
            on_batch(n)

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, event_type, n, total): counts by event time; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
