"""Packing of tokenised documents into training sequences, by histogram.

Documents are cut into pieces of at most one sequence. Only the histogram of piece lengths comes to
the driver (at most `size` numbers). Shortest-pack-first places the lengths from the longest on: each
goes into the open packs with the most room left, as many at once as the counts allow, which splits
or extends packing patterns but never looks at single documents.

A pattern's slots are runs of ranks: the k-th piece of a length, in the order of (partition, place
within it), belongs to the run that k falls in. Ranks come from counts by partition and length, so
that pieces meet their sequences without any global sort and without a hot key. Where these counts are few
they are broadcast, so that no piece moves.

Defined results: a null text is an empty one; every document has one more token, `end_id`, at its
end, so an empty one is a single piece of one token. Ids may repeat or be null; each row is packed.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CHUNK, codec
from .shared import written
from .text import rows_of, tidied

SIZE = 1024
PUT_ROWS = 1024  # pieces that are widened at once
BROADCAST_COUNTS = 250_000  # of some 160 bytes each in a task


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """[(number of packs, their lengths)]: every length of the histogram placed, none cut."""
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms: list[int] = []  # a queue of rooms, largest first; a room without packs is stale
    for length in sorted(histogram, reverse=True):
        left, put = histogram[length], []
        while left:
            while rooms and not open_[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                put.append((size - length, left, [length]))
                break
            room = -rooms[0]
            count, lengths = open_[room].pop()
            used = min(count, left)
            if used < count:
                open_[room].append((count - used, lengths))
            put.append((room - length, used, [*lengths, length]))
            left -= used
            if room - length >= length:  # may take this very length again
                open_[room - length].append(put.pop()[1:])
                heapq.heappush(rooms, length - room)
        for room, count, lengths in put:
            open_[room].append((count, lengths))
            heapq.heappush(rooms, -room)
    return [pack for packs in open_.values() for pack in packs]


class Placement:
    """Where the k-th piece of each length goes: runs of ranks, each on one slot of one pattern."""

    def __init__(self, packs: list[tuple[int, list[int]]]):
        runs, used, sequence = [], defaultdict(int), 0
        for count, lengths in packs:
            offset = 0
            for length in lengths:
                runs.append((length, used[length], sequence, offset))
                used[length] += count
                offset += length
            sequence += count
        runs.sort()
        length, self.rank, self.sequence, self.offset = np.array(runs, np.int64).reshape(-1, 4).T
        self.key = (length << 48) + self.rank

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        return self.sequence[run] + rank - self.rank[run], self.offset[run]


def _packed(ids: np.ndarray, offsets: np.ndarray, kind: str) -> pa.Array:
    width = np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])


_PIECES = pa.schema([("part", pa.int64()), ("length", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces(docs: DataFrame, path: str, id_col: str, text: str, size: int, end_id: int) -> DataFrame:
    """The tokenised pieces, each with its length's count so far in its partition. ids: 2 or 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, seen = codec(path, library=True), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        kind = id_kind(c)
        for batch in rows_of(batches, "text", CHUNK):
            ids, at = c.encode(batch.column("text").to_pylist())
            ids = np.insert(ids, at[1:], np.uint32(end_id))
            at = at + np.arange(len(at))
            tokens = np.diff(at)
            cuts = -(-tokens // size)
            doc = np.repeat(np.arange(len(tokens)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
            length = np.minimum(size, tokens[doc] - start)
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            place = np.empty(len(doc), np.int64)
            place[order] = np.arange(len(doc)) - first
            place += seen[length]
            seen += np.bincount(length, minlength=size + 1)
            columns = [np.full(len(doc), part), length, place, None, start, tokens[doc], None]
            columns = [None if x is None else pa.array(x.astype(np.int64)) for x in columns]
            columns[3] = batch.column("id").take(pa.array(doc))
            columns[6] = _packed(ids, np.append(at[doc] + start, at[-1]), kind)
            yield pa.record_batch(columns, schema=_PIECES)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(tidied(run), "part long, length long, place long, doc_id long, start long, doc_tokens long, ids binary")


def id_kind(c) -> str:
    return "<u2" if len(c.lengths) <= 1 << 16 else "<u4"


def pack(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = 0) -> DataFrame:
    """Per piece: its document, place there, ids as little-endian unsigned 32-bit integers, its sequence and place in it."""
    cut = written(pieces(docs, path, id_col, text, size, end_id), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placement = Placement(shortest_pack_first(histogram, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_kind(codec(path, library=True))
        for batch in (b.slice(i, PUT_ROWS) for b in batches for i in range(0, b.num_rows, PUT_ROWS)):
            length, place, base = (batch.column(c).to_numpy() for c in ("length", "place", "base"))
            sequence, offset = placement(length, place + base)
            raw = batch.column("ids").cast(pa.binary())
            begin = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            ids = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]].view(kind)
            wide = _packed(ids, (begin - begin[0]) // np.dtype(kind).itemsize, "<u4")
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "length")), wide, batch.column("doc_tokens"), pa.array(sequence), pa.array(offset)], schema=_PACKED)

    few = counts.count() <= BROADCAST_COUNTS  # else pieces move once, to meet their partition's ranks
    ranked = cut.join(F.broadcast(bases) if few else bases, ["part", "length"]).select("length", "place", "base", "doc_id", "start", "doc_tokens", "ids")
    return ranked.mapInArrow(tidied(put), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
