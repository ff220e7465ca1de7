"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

EDGE = "a long, b long"
HELD_EDGES = 1 << 20  # edges of a task that are made a forest at once


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least node, node) for each other node of a component: as many edges as a spanning forest has."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[child]], nodes[child]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What connects the same nodes as the edges (a, b) of a task, without cycles."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size = [(a, b)], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= HELD_EDGES:
            held = [spanning_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = 0
    a, b = spanning_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): of each node of `edges` (a, b; forests of their tasks), a node that stands for its component.

    Every round sends each node to its least neighbour's least neighbour and then the edges along, so
    that loops fall away: the edges shrink by a large part a round, and what a task has left of them
    is cut down to a forest before it is written. The rounds' maps, one after another, give the labels.
    Edges and maps are tables of the shared folder, so lineage stays short; no label comes to the driver.
    """
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("label", F.col("node"))
    for _ in range(max_rounds):
        if left.isEmpty():
            return written(labels, "labels")
        least = written(left.groupBy("b").agg(F.min("a").alias("next")), "next")
        after = least.select(F.col("b").alias("next"), F.col("next").alias("after"))
        step = written(least.join(after, "next", "left").select(F.col("b").alias("label"), F.coalesce("after", "next").alias("to")), "step")
        moved = left
        for end in ("a", "b"):
            moved = moved.join(step.withColumnRenamed("label", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = written(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).mapInArrow(forest, EDGE).distinct(), "edges")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    raise RuntimeError(f"edges are left after {max_rounds} rounds")
