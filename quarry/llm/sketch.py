"""Count-min sketches over hashes whose counters stop at two, dealt to shards and merged there.

A filter for repeats asks only whether a count is below two. The sketch is one array of cells for each
shard and row; a block of documents sends each shard the cells that it counts, and which of them it
counts twice: its own sketch of the shard, without the empty cells. The shard adds these sketches up
and tells each block, a bit a cell, which of its cells hold at least two. No sketch is ever in one
place, so its size follows the corpus, and a count is never too small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import ASK, ASK_SCHEMA, empty_ask
from .text import mix

ROWS = 2
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_LOW32, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


def cells_of(h: np.ndarray, row: int, shards: int, cells: int) -> np.ndarray:
    """Shard (upper 32 bits) and cell in it (lower 32 bits) of each key in a row of the sketch."""
    x = mix(h * _ODD[row])
    shard = ((x >> _32) * np.uint64(shards)) >> _32
    return shard << _32 | ((x & _LOW32) * np.uint64(cells)) >> _32


def block_sketch(block: int, keys: np.ndarray, shards: int, cells: int) -> pa.Table:
    """One row for each shard and row of the sketch in which the keys have cells: the cells, and a bit for each that is hit twice."""
    out = []
    for row in range(ROWS):
        at, count = np.unique(cells_of(keys, row, shards, cells), return_counts=True)
        shard = at >> _32
        first = np.flatnonzero(np.diff(shard, prepend=~shard[:1]))
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
            out.append((block, int(shard[i]), row, (at[i:j] & _LOW32).astype("<u4").tobytes(), np.packbits(count[i:j] > 1).tobytes(), b""))
    if not out:
        return empty_ask()
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), ASK_SCHEMA, strict=True)], schema=ASK_SCHEMA)


def merged(asked: DataFrame, cells: int) -> DataFrame:
    """To each block sketch, a bit for each of its cells: whether the merged sketch counts it at least twice."""

    def of_shard(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        sent = [np.frombuffer(x, "<u4") for x in table.column("h1").to_pylist()]
        twice = table.column("h2").to_pylist()
        answer = [b""] * len(sent)
        for row in range(ROWS):
            own = np.flatnonzero(kinds == row)
            total = np.zeros(cells, np.uint8)
            for i in own:
                more = 1 + np.unpackbits(np.frombuffer(twice[i], np.uint8), count=len(sent[i]))
                total[sent[i]] = np.minimum(total[sent[i]] + more, 2)
            for i in own:
                answer[i] = np.packbits(total[sent[i]] > 1).tobytes()
        return table.set_column(3, ASK_SCHEMA.field(3), pa.array(answer, pa.binary())).set_column(4, ASK_SCHEMA.field(4), pa.array([b""] * len(answer), pa.binary())).cast(ASK_SCHEMA)

    return asked.groupBy("shard").applyInArrow(of_shard, ASK)


class Estimates:
    """What the shards have told a block about the sketch of all its keys."""

    def __init__(self, all_keys: np.ndarray, told: pa.Table, shards: int, cells: int):
        self.shards, self.cells = shards, cells
        rows = zip(*(told.column(c).to_pylist() for c in ("kind", "shard", "h1")), strict=True)
        bits = {(kind, shard): x for kind, shard, x in rows if kind < ROWS}
        self.rows = []
        for row in range(ROWS):
            at = np.unique(cells_of(all_keys, row, shards, cells))
            shard = (at >> _32).astype(np.int64)
            first = np.flatnonzero(np.diff(shard, prepend=-1))
            size = np.diff(np.append(first, len(at)))
            again = [np.unpackbits(np.frombuffer(bits[row, s], np.uint8), count=n) for s, n in zip(shard[first].tolist(), size.tolist(), strict=True)]
            self.rows.append((at, np.concatenate([np.zeros(0, np.uint8), *again]) > 0))

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys may occur twice."""
        out = np.ones(len(keys), bool)
        for row, (at, again) in enumerate(self.rows):
            out &= again[np.searchsorted(at, cells_of(keys, row, self.shards, self.cells))]
        return out
