"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combining and two joins; labels
stay in tables of the shared folder, never on the driver.  Partition-local
spanning forests come first, so that dense groups reach the rounds as stars.
What is aggregated is written before it is joined: the join is then dealt anew,
and a node of very many links is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.shared import discard, stored
from tesserae.llm.textcore import tidied

#: Edges a task holds at once while it thins them to a spanning forest.
FOREST_EDGES = 2_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) with the components of edges (u, v); roots are smallest nodes."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(root, before):
            break
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    us, vs, held = [], [], 0

    def out() -> pa.RecordBatch:
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        held += len(us[-1])
        if held > FOREST_EDGES:
            yield out()
            us, vs, held = [], [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u long, v long) links in, (node long, root long) out; root is the smallest node of its component.

    Only nodes with a link to another node appear.  Self links and repeated
    links are allowed; a link with a null end is ignored; no links give no rows.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = e.mapInArrow(tidied(_thin), "u long, v long").where("u <> v")
    e = stored(e, name)  # u > v from here on
    while True:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = e.union(e.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        # small star: smaller neighbours and the node itself move to the smallest
        lows = stored(large.groupBy("u").agg(F.min("v").alias("m")), name)
        pairs = large.join(lows, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = stored(small.where("u > v"), name)
        discard(e, least, large, lows)
        # finished when the links are stars: no root has a link down, no node two roots
        state = nxt.groupBy("u").agg(F.count("*").alias("n")).alias("a")
        bad = state.where("n > 1").limit(1).count() or nxt.alias("x").join(nxt.select(F.col("u").alias("w")), F.col("x.v") == F.col("w"), "left_semi").limit(1).count()
        e = nxt
        if not bad:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
