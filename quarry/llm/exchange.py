"""Blocks of documents that ask shards about hashed strings and get answers back.

Documents are dealt to blocks by a hash of their contents. A block sends each distinct string
(as a 128-bit hash) once to the shard that the hash names, packed into a few binary rows, so a
string that fills a third of the corpus is as many entries as there are blocks, and no key is hot.
A shard answers for each block; the block's documents meet the answers by block number.
Both numbers follow from the corpus's bytes, so a block or a shard has the same size at any scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import numpy.typing
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASK = "block int, shard int, kind int, h1 binary, h2 binary, value binary"
ASK_SCHEMA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("value", pa.binary())])
BLOCK_BYTES = 8 << 20


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def blocks_for(size: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, -(-size // block_bytes))


BLOCKS_A_TASK = 32


def in_blocks(docs: DataFrame, id_col: str, text: str, n: int, carry: Sequence[str] = ()) -> DataFrame:
    """(block, id, text, carried_0, carried_1, ...: the columns to carry). Equal ids and texts share a block; the rest is dealt evenly.

    Blocks bound what is in memory at once, not the number of tasks: up to BLOCKS_A_TASK share a
    partition where there are more blocks than shuffle partitions.
    """
    tasks = min(n, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BLOCKS_A_TASK)))
    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *carried)
    return picked.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("block"), "*").repartition(tasks, "block")


def packed(block: int, shards: int, kind: int, h1: np.ndarray, h2: np.ndarray, value: np.ndarray) -> pa.Table:
    """One row per shard that gets anything, with its hashes; h1 must be sorted, as shards are ranges of h1."""
    shard = ((h1 >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(shard, prepend=~shard[:1]))
    bounds = np.append(first, len(h1))
    n = len(first)
    parts = [[x[bounds[i] : bounds[i + 1]].tobytes() for i in range(n)] for x in (h1, h2, value)]
    return pa.table([pa.array(np.full(n, block, np.int32)), pa.array(shard[first].astype(np.int32)), pa.array(np.full(n, kind, np.int32)), *(pa.array(p, pa.binary()) for p in parts)], schema=ASK_SCHEMA)


def unpacked(table: pa.Table | pa.RecordBatch, value_type: np.typing.DTypeLike) -> tuple[np.ndarray, ...]:
    """(h1, h2, value, index of the row) of all entries of packed rows."""

    def column(name: str, kind: np.typing.DTypeLike) -> np.ndarray:
        parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist() if x]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    counts = np.array([len(x or b"") // 8 for x in table.column("h1").to_pylist()], np.int64)
    return column("h1", np.uint64), column("h2", np.uint64), column("value", value_type), np.repeat(np.arange(len(counts)), counts)


def grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): order sorts by (h1, h2); starts are the places in it where a new string begins."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if np.any(same & (b[1:] != b[:-1])):  # equal strings may not be neighbours yet
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = a[1:] == a[:-1]
    new = np.ones(len(a), bool)
    new[1:] = ~(same & (b[1:] == b[:-1]))
    return order, np.flatnonzero(new)


Decision = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def by_string(decide: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Decision:
    """decide(values in order of their strings, starts of the strings) -> (which get an answer, the answers), in that order."""

    def decision(h1: np.ndarray, h2: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, starts = grouped(h1, h2)
        keep, answer = decide(value[order], starts)
        return order[keep], answer[keep]

    return decision


def answers(asked: DataFrame, value_type: np.typing.DTypeLike, decide: Decision) -> DataFrame:
    """What each shard answers: decide(h1, h2, value) over all its entries -> (entries that get an answer, the answers)."""

    def of_shard(table: pa.Table) -> pa.Table:
        h1, h2, value, row = unpacked(table, value_type)
        chosen, answer = decide(h1, h2, value)
        if not len(chosen):
            return ASK_SCHEMA.empty_table()
        block = np.array(table.column("block").to_numpy(), np.int64)[row[chosen]]
        kind = table.column("kind")[0].as_py()
        by = np.argsort(block, kind="stable")
        out, edges = [], np.flatnonzero(np.diff(block[by], prepend=-1))
        for i, j in zip(edges, np.append(edges[1:], len(by)), strict=True):
            at = by[i:j]
            out.append((int(block[at[0]]), 0, kind, h1[chosen[at]].tobytes(), h2[chosen[at]].tobytes(), answer[at].tobytes()))
        return pa.Table.from_pylist([dict(zip(ASK_SCHEMA.names, x, strict=True)) for x in out], schema=ASK_SCHEMA)

    return asked.groupBy("shard").applyInArrow(of_shard, ASK)


def empty_ask() -> pa.Table:
    return ASK_SCHEMA.empty_table()


def one_block(table: pa.Table, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    from .text import rows_of

    yield from rows_of(table.combine_chunks().to_batches(), "text", limit)


def found(h1: np.ndarray, h2: np.ndarray, asked1: np.ndarray, asked2: np.ndarray) -> np.ndarray:
    """Index into (h1, h2), sorted by h1, of each asked pair, or -1."""
    if not len(h1):
        return np.full(len(asked1), -1)
    at = np.searchsorted(h1, asked1)
    at[at == len(h1)] = 0
    hit = (h1[at] == asked1) & (h2[at] == asked2)
    for i in np.flatnonzero(~hit & (h1[at] == asked1)):  # two strings with one h1
        j = at[i]
        while j < len(h1) and h1[j] == asked1[i]:
            if h2[j] == asked2[i]:
                at[i], hit[i] = j, True
                break
            j += 1
    return np.where(hit, at, -1)
