"""Token ids of a corpus as flat unsigned integer files with 64-bit document offsets.

A written corpus is a folder of parts in id order.  For part k:

* ``part-k.bin``  ids, little-endian, 16 bits each if the vocabulary allows, else 32;
* ``part-k.idx``  n + 1 little-endian 64-bit offsets, in ids from the part's beginning;
* ``part-k.doc``  n little-endian 64-bit document ids (-2^63 stands for null);
* ``manifest.json``  each part's documents and ids, and its base: the prefix sum of the ids before it.

Parts are written by tasks under a temporary name and then renamed, so a task
that runs twice leaves one whole part.  Readers map the files into memory.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tesserae.llm.encoding import encoder
from tesserae.llm.shared import parallelism
from tesserae.llm.textcore import gather_runs, text_blocks, tidied

NULL_ID = -(1 << 63)


def filesystem(uri: str):
    """A filesystem and the path within it; a URI without a scheme is a local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t string) in ranges of ids, each range sorted; equal ids are ordered by a hash of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    return rows.repartitionByRange(parallelism(docs.sparkSession), "id", "h").sortWithinPartitions("id", "h", "t").drop("h")


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids and then the end id."""
    n = len(at) - 1
    to = at + np.arange(n + 1)
    out = np.full(to[-1], end_id, np.uint32)
    out[gather_runs(to[:-1], np.diff(at))] = ids
    return out, to


@dataclass
class TokenFiles:
    """A written corpus: its folder and the manifest."""

    path: str
    dtype: str
    parts: list[dict]

    def documents(self, spark: SparkSession) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files."""
        return self._read(spark, "doc_id long, start long, n_tokens long, ids_crc32 long", False)

    def ids(self, spark: SparkSession) -> DataFrame:
        """(doc_id, start, ids array<long>) of each document, read back from the files."""
        return self._read(spark, "doc_id long, start long, ids array<long>", True)

    def _read(self, spark: SparkSession, schema: str, whole: bool) -> DataFrame:
        path, dtype = self.path, self.dtype
        rows = [(p["name"], p["base"]) for p in self.parts]
        names = spark.createDataFrame(rows, "name string, base long")
        names = names.repartition(max(1, len(rows)), "name") if rows else names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    idx, doc, ids = (mapped(f"{path}/{name}.{x}", t) for x, t in (("idx", "<u8"), ("doc", "<i8"), ("bin", dtype)))
                    for i in range(0, len(doc), 4096):
                        at = idx[i : i + 4097].astype(np.int64)
                        block = np.asarray(ids[at[0] : at[-1]]).astype("<u4")
                        at0 = at - at[0]
                        own = doc[i : i + 4096]
                        head = [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(at[:-1] + base)]
                        if whole:
                            yield pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array(at0.astype(np.int32)), pa.array(block.astype(np.int64)))], ["doc_id", "start", "ids"])
                        else:
                            data = memoryview(block.tobytes())
                            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at0[:-1].tolist(), at0[1:].tolist())]
                            yield pa.RecordBatch.from_arrays([*head, pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return names.mapInArrow(tidied(run), schema)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the filesystem is local, else read."""
    fs, path = filesystem(uri)
    if fs.type_name == "local":
        if not fs.get_file_info(path).size:
            return np.empty(0, dtype)
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Writes the ids of whole texts, each with ``end_id`` behind it, in ascending id order.

    ``path`` is a new folder that all executors share.  Ids are integers, since
    the format stores 64 bits each; other types are refused.  Null texts are empty:
    the end id alone.  Null ids come first.  Equal ids are ordered by their
    texts' hash and repeated rows are all written.  An empty table gives a
    manifest without documents.  Other columns are ignored.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column; the files store 64-bit ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        name = f"part-{TaskContext.get().partitionId():06d}"
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        temp = f"{folder}/_{name}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{temp}.bin") as out, fs.open_output_stream(f"{temp}.idx") as idx, fs.open_output_stream(f"{temp}.doc") as doc:
            idx.write(np.zeros(1, "<u8").tobytes())
            for b in batches:
                texts = b.column(1)
                for i, j in text_blocks(texts):
                    ids, at = with_end(*enc.encode(texts.slice(i, j - i)), end_id)
                    out.write(ids.astype(kind).tobytes())
                    idx.write((at[1:] + n_ids).astype("<u8").tobytes())
                    doc.write(b.column(0).slice(i, j - i).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    n_docs += j - i
                    n_ids += len(ids)
        for x in ("bin", "idx", "doc"):
            fs.move(f"{temp}.{x}", f"{folder}/{name}.{x}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([kind])], ["name", "n_docs", "n_ids", "kind"])

    # one row a part comes back, whatever the size of the corpus
    found = sorted(in_id_order(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col).mapInArrow(tidied(run), "name string, n_docs long, n_ids long, kind string").collect())
    parts, base = [], 0
    for r in found:
        parts.append({"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "base": base})
        base += r["n_ids"]
    dtype = found[0]["kind"] if found else "<u4"
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "end_id": end_id, "parts": parts}).encode())
    return TokenFiles(path, dtype, parts)


def open_token_files(path: str) -> TokenFiles:
    fs, folder = filesystem(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        spec = json.loads(f.read())
    return TokenFiles(path, spec["dtype"], spec["parts"])
