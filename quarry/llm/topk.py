"""Exact top-k inner products by KD-trees, one per shard of the vectors.

Vectors are quantised to integers, so scores are exact. The top of a KD-tree, median splits of the
widest dimension, deals the vectors to shards that lie apart; it is built from a bounded sample, which
only decides where the splits are: every vector is in a shard, and boxes are of all its vectors. A
shard that gets more vectors than its size is dealt on by a hash. Each shard's tree goes on splitting
at medians and keeps every node's tight bounding box. A query visits nodes best-first by the largest
inner product that a box allows, and stops at the first bound below its kth score so far.

Queries first ask the shard whose box promises most. Their kth scores decide which other shards they
go to, those whose box reaches that score, and start the search there. A shard's vectors move once, its
tree is built once a round, and its queries stream past it, so what is in memory is one tree and one
batch of queries. Only the shards' boxes are broadcast, at most MAX_SHARDS of them for the splits.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; rows with one id count once (the smallest vector); a query meets only vectors of its own
dimension; equal scores go to the smaller id; fewer candidates than k give fewer rows; a score beyond
64 bits is the largest or smallest 64-bit number, and ranked as such.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import place, written
from .text import tidied

SHARD_ROWS = 64 << 10
LEAST_ROWS = 4 << 10  # of a shard, where fewer shards than tasks would do
MAX_SHARDS = 4096  # that splits tell apart
SAMPLE = 16 << 10  # vectors of which the splits are the medians
LEAF = 256
_MOST = np.iinfo(np.int64).max


@dataclass
class Tree:
    """Rows ordered by leaf; node i covers rows first[i]:last[i] and has children left[i], right[i] or -1."""

    ids: np.ndarray
    rows: np.ndarray
    first: list[int]
    last: list[int]
    left: list[int]
    right: list[int]
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        nodes: list[list[int]] = []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = rows[order[a:b]]
            low, high = here.min(axis=0), here.max(axis=0)
            number = len(nodes)
            nodes.append([a, b, -1, -1])
            boxes.append((low, high))
            if parent >= 0:
                nodes[parent][2 + side] = number
            axis = int(np.argmax(high - low))
            if b - a > leaf and high[axis] > low[axis]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(here[:, axis], middle)]
                todo += [(a, a + middle, number, 0), (a + middle, b, number, 1)]
        first, last, left, right = (list(x) for x in zip(*nodes, strict=True))
        return cls(ids[order], rows[order], first, last, left, right, np.array([x[0] for x in boxes]), np.array([x[1] for x in boxes]))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return box_bounds(self.low, self.high, queries)

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k of at least kth, in order."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < kth:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= kth:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            a, b = self.first[node], self.last[node]
            score = inner_products(self.rows[a:b], query)
            near = np.flatnonzero((score >= kth) & (self.ids[a:b] != query_id))
            if len(near):
                ids, scores = np.concatenate([ids, self.ids[a:b][near]]), np.concatenate([scores, score[near]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, scores[-1])
        return ids, scores


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact, as 64-bit integers; what is beyond their range becomes its end."""
    most = rows.shape[1] * np.abs(rows).max(initial=0) * np.abs(query).max(initial=0)
    if most < 1 << 53:
        return (rows @ query).astype(np.int64)
    if most < 1 << 62 and max(np.abs(rows).max(initial=0), np.abs(query).max(initial=0)) < 1 << 62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query]
    return np.array([max(-_MOST, min(_MOST, sum(int(x) * y for x, y in zip(row, q, strict=True)))) for row in rows], np.int64)


def box_bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """queries x boxes: the largest inner product that each box allows, with room for rounding where it is not exact."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = low.shape[1] * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * np.abs(queries).max(initial=0)
        out = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        return out if most < 1 << 53 else np.nan_to_num(out + most * low.shape[1] * 1e-15, nan=np.inf, posinf=np.inf, neginf=np.inf)


def quantised(column: pa.Array) -> list[np.ndarray | None]:
    """floor(256 * x) of each vector as whole doubles; None for vectors that take no part."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        with np.errstate(over="ignore"):
            x = np.floor(256 * np.array(v, np.float64))
        out.append(np.clip(x, -np.finfo(float).max, np.finfo(float).max) if len(x) and np.isfinite(np.array(v, np.float64)).all() else None)
    return out


@dataclass
class Splits:
    """The top of a KD-tree over vectors of one dimension: node i sends values below at[i] in axis[i] to left[i], else to right[i]; a shard s is -1 - s."""

    axis: list[int]
    at: list[float]
    left: list[int]
    right: list[int]

    @classmethod
    def of(cls, sample: np.ndarray, shards: int) -> Splits:
        out, made = cls([], [], [], []), 0

        def split(rows: np.ndarray, n: int) -> int:
            nonlocal made
            spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
            axis = int(np.argmax(spread))
            if n < 2 or len(rows) < 2 or not spread[axis]:
                made += 1
                return -made
            at = float(np.median(rows[:, axis]))
            lower = rows[:, axis] < at
            if not lower.any():  # more than half are the least: they go left alone
                at = float(rows[rows[:, axis] > at, axis].min())
                lower = rows[:, axis] < at
            node = len(out.axis)
            for x, value in zip((out.axis, out.at, out.left, out.right), (axis, at, 0, 0), strict=True):
                x.append(value)
            out.left[node] = split(rows[lower], n // 2)
            out.right[node] = split(rows[~lower], n - n // 2)
            return node

        split(sample, shards)
        return out

    def shard_of(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64) if self.axis else np.full(len(rows), -1)
        while len(inner := np.flatnonzero(node >= 0)):
            i = node[inner]
            lower = rows[inner, np.array(self.axis)[i]] < np.array(self.at)[i]
            node[inner] = np.where(lower, np.array(self.left)[i], np.array(self.right)[i])
        return -1 - node


def _matrix(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<f8").reshape(len(packed), -1)


def _by_dimension(packed: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, vectors) of each dimension among packed vectors."""
    size = pa.compute.binary_length(packed).to_numpy(zero_copy_only=False) // 8
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, _matrix(packed.take(pa.array(at)))


_VECTOR = "id long, vector binary"
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector: packed doubles) of the rows that take part, one an id."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = quantised(batch.column("vector"))
            keep = [i for i, v in enumerate(values) if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array([values[i].astype("<f8").tobytes() for i in keep], pa.binary())], ["id", "vector"])

    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector")).filter("id is not null")
    return named.mapInArrow(numbers, _VECTOR).groupBy("id").agg(F.min("vector").alias("vector"))


def dealt(spark: SparkSession, named: DataFrame, shard_rows: int) -> DataFrame:
    """(id, vector, shard) in the shared folder. A shard is named by its vectors' dimension, its place among the splits and a hash where it is too full."""
    n = named.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MAX_SHARDS, max(1, -(-n // shard_rows), min(tasks, -(-n // LEAST_ROWS))))
    sample = named.select("vector").orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow().column("vector").combine_chunks() if wanted > 1 else pa.array([], pa.binary())
    splits = {d: Splits.of(rows, wanted) for d, _, rows in _by_dimension(sample)} if len(sample) else {}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = np.zeros(batch.num_rows, np.int64)
            for d, at, rows in _by_dimension(batch.column("vector")):
                shard[at] = d * MAX_SHARDS + (splits[d].shard_of(rows) if d in splits else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(shard)], ["id", "vector", "split"])

    path = place(spark, "dealt")
    named.mapInArrow(deal, f"{_VECTOR}, split long").write.parquet(path)
    placed = spark.read.parquet(path)
    full = placed.groupBy("split").agg(F.ceil(F.count("*") / (2 * shard_rows)).alias("parts"))
    return placed.join(F.broadcast(full), "split").select("id", "vector", F.struct("split", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")).alias("shard"))  # at most MAX_SHARDS rows a dimension


def boxes(placed: DataFrame) -> DataFrame:
    """(split, low, high: packed) of each split's vectors."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            split = batch.column("split").to_numpy()
            low, high = batch.column("low"), batch.column("high")
            for s in np.unique(split).tolist():
                at = pa.array(np.flatnonzero(split == s))
                a, b = _matrix(low.take(at)).min(axis=0), _matrix(high.take(at)).max(axis=0)
                held[s] = (np.minimum(held[s][0], a), np.maximum(held[s][1], b)) if s in held else (a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x[0].tobytes() for x in held.values()], pa.binary()), pa.array([x[1].tobytes() for x in held.values()], pa.binary())], ["split", "low", "high"])

    schema = "split long, low binary, high binary"
    one = placed.select(F.col("shard.split").alias("split"), F.col("vector").alias("low"), F.col("vector").alias("high")).mapInArrow(local, schema)
    return one.repartition("split").mapInArrow(local, schema)


def searched(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each query (id, vector, shard, kth), the best k of its shard's vectors (id, vector, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held = None, None, []

        def planted() -> Tree | None:
            if not held:
                return None
            ids = np.concatenate([b.column("id").to_numpy() for b in held])
            return Tree.build(ids, np.concatenate([_matrix(b.column("vector")) for b in held]))

        for batch in batches:
            split, part, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("split", "part", "is_query"))
            change = (np.diff(split) != 0) | (np.diff(part) != 0) | (np.diff(is_query.astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if (split[a], part[a]) != shard:
                    shard, tree, held = (split[a], part[a]), None, []
                here = batch.slice(a, b - a)
                if not is_query[a]:
                    held.append(here)
                    continue
                if tree is None and held:
                    tree, held = planted(), []
                if tree is None:
                    continue
                for start in range(0, here.num_rows, 256):
                    some = here.slice(start, 256)
                    q = _matrix(some.column("vector"))
                    bounds = tree.bounds(q)
                    out = [(i, *tree.search(i, row, bound, k, -np.inf if kth is None else kth)) for i, row, bound, kth in zip(some.column("id").to_pylist(), q, bounds, some.column("kth").to_pylist(), strict=True)]
                    n = [len(x[1]) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], n), pa.int64()), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], schema=_OUT)

    columns = ["id", "vector", F.col("shard.split").alias("split"), F.col("shard.part").alias("part")]
    both = rows.select(*columns, F.lit(None).cast("long").alias("kth"), F.lit(False).alias("is_query")).unionByName(asked.select(*columns, "kth", F.lit(True).alias("is_query")))
    return both.repartition("split", "part").sortWithinPartitions("split", "part", "is_query").mapInArrow(tidied(run), "query_id long, vec_id long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, queries_where: str, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows. queries_where: a condition on `id`."""
    named = written(quantised_vectors(vectors, id_col, vector), "quantised")
    rows = dealt(spark, named, shard_rows)
    found = boxes(rows).toArrow()  # two vectors a split, of at most MAX_SHARDS splits a dimension
    parts = {r.split: r.parts for r in rows.select("shard.*").groupBy("split").agg((F.max("part") + 1).alias("parts")).collect()}
    held = [(s, np.frombuffer(a, "<f8"), np.frombuffer(b, "<f8"), parts[s]) for s, a, b in zip(*(found.column(c).to_pylist() for c in ("split", "low", "high")), strict=True)]
    of_dimension: dict[int, tuple] = {}
    for d in {len(x[1]) for x in held}:
        own = [x for x in held if len(x[1]) == d]
        of_dimension[d] = (np.array([x[0] for x in own]), np.stack([x[1] for x in own]), np.stack([x[2] for x in own]), np.array([x[3] for x in own]))
    shared = spark.sparkContext.broadcast(of_dimension)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without a kth score: to the split whose box promises most. With one: to all others that reach it; null for a query that has found fewer than k."""
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                asked_before = batch.column("asked").to_numpy(zero_copy_only=False)
                kth = np.array([-np.inf if x is None else x for x in batch.column("kth").to_pylist()], float)
                query, split, part, best = [], [], [], []
                for d, at, q in _by_dimension(batch.column("vector")):
                    name, low, high, n = shared.value[d]
                    bound = box_bounds(low, high, q)
                    first = bound.argmax(axis=1)
                    for i, row, own, own_bound in zip(at.tolist(), range(len(q)), first.tolist(), bound, strict=True):
                        reach = np.array([own]) if not asked_before[i] else np.flatnonzero(own_bound >= kth[i])
                        for s in reach.tolist():
                            query += [i] * int(n[s])
                            split += [int(name[s])] * int(n[s])
                            part += range(int(n[s]))
                            best += [s == own] * int(n[s])
                keep = np.flatnonzero(~np.array(best, bool) | ~asked_before[query]) if query else np.zeros(0, np.int64)
                taken = pa.array(np.array(query, np.int64)[keep])
                shard = pa.StructArray.from_arrays([pa.array(np.array(split, np.int64)[keep]), pa.array(np.array(part, np.int32)[keep], pa.int32())], ["split", "part"])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("vector").take(taken), shard, batch.column("kth").take(taken)], ["id", "vector", "shard", "kth"])

    schema = "id long, vector binary, shard struct<split:long,part:int>, kth long"
    queries = named.filter(queries_where)
    asked = queries.withColumns({"kth": F.lit(None).cast("long"), "asked": F.lit(False)}).mapInArrow(route, schema)
    first = written(best_of(searched(rows, asked, k), k), "first-shard")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("kth"))
    asked = queries.join(kth, "id", "left").withColumn("asked", F.lit(True)).mapInArrow(route, schema)
    return best_of(first.drop("rank").unionByName(searched(rows, asked, k)), k).select("query_id", "rank", "vec_id", "score")


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "id % 50 = 0")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
