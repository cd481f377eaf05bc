"""Line deduplication with built-in functions only.

Lines become rows of a 128-bit key hash, document and position.  The rows are
range-partitioned by hash and sorted by document and position within, so that
one pass over each key's rows marks its first occurrence and counts its
documents.  Marks return to the documents as run-length bitmaps of dropped
lines, never as text.

A very common line would put all its rows into one range.  Such heavy keys are
found by frequent-items sketches, one for each of SKETCHES shares of the hashes,
so that no task merges more than its share; their rows are summed where they
stand (map-side) and the sums, at most SKETCHES * HEAVY rows, broadcast back.  A
key is heavy above HEAVY_ROWS rows, or above a share of a small table, however
large the corpus; what the sketches can't list has less than one in
SKETCHES * HEAVY of its share's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.shared import parallelism, stored

WHITE = " \t\n\x0b\x0c\r"
A_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sketches, keys that each lists, and keys that each tracks.
SKETCHES, HEAVY, TRACKED = 64, 256, 4096
#: A key of more rows is summed in place: the absolute bound, and the share of a table's rows that counts below it, from LEAST_ROWS on.
HEAVY_ROWS, HEAVY_SHARE, LEAST_ROWS = 1_000_000, 1024, 1000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), A_Z, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, th, pos, a, b): a row per line whose key has ``min_chars`` code points; th tells rows with one id apart."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.lit(3), text_col).alias("th"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    rows = rows.select("doc", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return rows.select("doc", "th", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b"))


def runs(positions: Column) -> Column:
    """Ascending distinct positions as runs [first, last]."""
    from tesserae.llm.quality import let

    def of(p: Column) -> Column:
        firsts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
        lasts = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        return F.arrays_zip(firsts.alias("first"), lasts.alias("last"))

    return let(positions, of)


def keep_flags(n_lines: Column, dropped: Column) -> Column:
    """array<boolean>: whether each line stays, from runs of dropped lines."""
    from tesserae.llm.quality import let

    def of(d: Column) -> Column:
        parts = F.transform(d, lambda r, i: F.concat(F.array_repeat(F.lit(True), (r["first"] - F.when(i == 0, F.lit(0)).otherwise(F.get(d, i - 1)["last"] + 1)).cast("int")), F.array_repeat(F.lit(False), (r["last"] - r["first"] + 1).cast("int"))))
        tail = F.array_repeat(F.lit(True), (n_lines - F.when(F.size(d) > 0, F.element_at(d, -1)["last"] + 1).otherwise(F.lit(0))).cast("int"))
        return F.concat(F.flatten(parts), tail)

    return let(dropped, of)


def dropped_lines(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, dropped): runs of dropped lines, for rows that lose any."""
    # the texts are cut into lines once; sketch, ranges and sums read the small rows
    rows = stored(line_rows(docs, id_col, text_col, min_chars), "lines")
    sketches = rows.groupBy(F.pmod("b", F.lit(SKETCHES))).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(a, {HEAVY}, {TRACKED})").alias("top")).collect()
    limit = min(HEAVY_ROWS, max(LEAST_ROWS, sum(s["n"] for s in sketches) // HEAVY_SHARE))
    heavy = [x["item"] for s in sketches for x in s["top"] if x["count"] > limit]  # SKETCHES * HEAVY at most
    is_heavy = F.col("a").isin(heavy) if heavy else F.lit(False)

    # light keys: ranges of hashes, documents and positions in order within; one pass over each key's rows
    light = rows.where(~is_heavy).repartitionByRange(parallelism(docs.sparkSession), "a", "b")
    by_key = Window.partitionBy("a", "b")
    ordered = by_key.orderBy("doc", "th", "pos")
    light = light.withColumns({"n": F.row_number().over(ordered), "new": (F.lag(F.struct("doc")).over(ordered) == F.struct("doc"))})
    light = light.withColumns({"docs": F.sum(F.when(F.col("new"), 0).otherwise(1)).over(by_key)})
    marked = light.where((F.col("docs") >= min_docs) & ((F.col("n") > 1) if keep_first else F.lit(True))).select("doc", "th", "pos")

    if heavy:
        # heavy keys: sums by key of one row per document, joined back where the lines are
        hot = rows.where(is_heavy)
        per_doc = hot.groupBy("a", "b", "doc").agg(F.min(F.struct("th", "pos")).alias("at"))
        sums = per_doc.groupBy("a", "b").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "at")).alias("first"))
        sums = sums.where(F.col("docs") >= min_docs).withColumnsRenamed({"a": "ka", "b": "kb"})
        hit = hot.join(F.broadcast(sums), (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")))  # as many rows as heavy keys
        if keep_first:
            hit = hit.where(~(F.struct("doc", "th", "pos").eqNullSafe(F.struct(F.col("first.doc").alias("doc"), F.col("first.at.th").alias("th"), F.col("first.at.pos").alias("pos")))))
        marked = marked.union(hit.select("doc", "th", "pos"))
    return marked.groupBy("doc", "th").agg(runs(F.sort_array(F.collect_set("pos"))).alias("dropped"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, dropped array<struct<first,last>>) per row: which lines of a text go, as runs.

    A line's key is the line stripped of white space with A-Z lower-cased.  Keys
    of ``min_chars`` code points found in ``min_docs`` documents or more lose
    their lines; ``keep_first`` spares the first by (id, position).  Documents
    are told apart by id.  A null or empty text is one empty line, which has no
    key; a null id counts as one document, and comes first; repeated rows lose
    the same lines; an empty table gives no rows; other columns are ignored.
    """
    marks = dropped_lines(docs, min_docs, min_chars, keep_first, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.lit(3), text_col).alias("th"), F.size(lines_of(F.col(text_col))).cast("long").alias("n_lines"))
    return _joined(rows, marks).select(F.col("doc").alias(id_col), "n_lines", "dropped")


def _joined(rows: DataFrame, marks: DataFrame) -> DataFrame:
    m = marks.withColumnsRenamed({"doc": "mdoc", "th": "mth"})
    out = rows.join(m, F.col("doc").eqNullSafe(F.col("mdoc")) & (F.col("th") == F.col("mth")), "left").drop("mdoc", "mth")
    return out.withColumn("dropped", F.coalesce("dropped", F.expr("cast(array() as array<struct<first:int,last:int>>)")))


def line_dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as text, and n_lines and n_dropped behind its columns.

    See ``keep_bitmaps`` for what is dropped and for the edge cases; a null text
    becomes the empty text.  Columns n_lines and n_dropped of the input are replaced.
    """
    marks = dropped_lines(docs, min_docs, min_chars, keep_first, id_col, text_col)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    packed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.lit(3), text_col).alias("th"), F.struct(*names).alias("row"))
    joined = _joined(packed, marks)
    from tesserae.llm.quality import let

    lines = lines_of(F.col("row")[text_col])
    kept = F.when(F.size("dropped") == 0, F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))).otherwise(
        let(lines, lambda x: let(keep_flags(F.size(x), F.col("dropped")), lambda keep: F.array_join(F.filter(x, lambda _, i: F.get(keep, i)), "\n")))
    )
    n_dropped = F.aggregate("dropped", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return joined.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))
