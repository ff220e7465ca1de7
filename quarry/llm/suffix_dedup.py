"""Exact removal of byte strings that an earlier document holds, by prefix-free parsing.

A rolling hash of the last bytes triggers phrase ends, wherever the bytes occur, so copied text is cut
alike. The dictionary of distinct phrases (with the bytes that a window may reach beyond them) gives
each phrase the smallest id that holds it: what a later document copied is decided phrase by phrase,
and only the text of a phrase's first holder goes on. There, a window is left if its anchor (the
least-hashed gram in it) is held by another document too; any other window occurs once and its place
in the corpus's order decides nothing. What is left is put into order: the bytes around each anchor
go to the shard that the anchor names, so equal windows meet in one shard. A shard parses its text
into phrases again, finer, builds the dictionary's suffix array and the parse's suffix array, and
combines both into the order of the suffixes at which windows begin. Neighbours that share a whole
window have the smallest id among them.

Every exchange is between blocks and shards of a fixed size (see exchange.py), so a passage that a
third of the corpus holds is one entry a block.

Defined results: a null text is empty; a row without an id is never an earlier document and loses
nothing; rows that repeat an id are one document's copies and remove nothing from each other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import exchange as X
from .suffix import prefix_free_order
from .text import _P, _Q, _R, buffer_of, cover, mix, range_hash, sliding, tidy

WINDOW, GRAM, TRIGGER = 50, 24, 8
PHRASE_BITS, PARSE_BITS = 7, 5  # a trigger in 2**bits places: of documents, of what is sorted
CHUNK = 1 << 19
SORTED_AT_ONCE = 4096  # contexts
BLOCK_BYTES = 4 << 20
_NONE = np.int64(np.iinfo(np.int64).max)
OUT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:int,end:int>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


class Chunk:
    """The bytes and phrases of some documents of a block. What has a number a byte is made when it is asked for."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.window = window
        self.ids = batch.column("id")
        self.carried = [batch.column(c) for c in batch.schema.names if c.startswith("carried_")]
        self.raw, self.offsets = buffer_of(batch.column("text"))
        self.id = np.array(self.ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        self.named = np.array(self.ids.is_valid().to_numpy(zero_copy_only=False), bool)
        self._phrases()

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def valid(self) -> np.ndarray:
        """Starts of windows, of documents with an id."""
        out = np.zeros(len(self.raw) + 1, np.int8)
        last = self.offsets[1:] - self.window + 1
        some = self.named & (last > self.offsets[:-1])
        np.add.at(out, self.offsets[:-1][some], 1)
        np.subtract.at(out, last[some], 1)
        return np.cumsum(out[:-1], dtype=np.int8) > 0

    def _phrases(self) -> None:
        n = len(self.raw)
        begin = triggers(_eight(self.raw), PHRASE_BITS)
        begin[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        begin &= self.valid()
        self.start = np.flatnonzero(begin)
        doc = self.doc_of(self.start)
        limit = np.minimum(np.append(self.start[1:], n), self.offsets[1:][doc] - self.window + 1)
        self.stop = np.maximum(limit, self.start + 1)  # windows that begin in the phrase
        whole = self.stop + self.window - 1
        self.h1 = mix(range_hash(self.raw, self.start, whole, _P))
        self.h2 = mix(range_hash(self.raw, self.start, whole, _Q))
        self.holder = self.id[doc] if len(doc) else np.zeros(0, np.int64)

    def copied(self, least: np.ndarray) -> np.ndarray:
        """Windows of phrases that a document with a smaller id holds."""
        delta = np.zeros(len(self.raw) + 1, np.int32)
        gone = least < self.holder
        np.add.at(delta, self.start[gone], 1)
        np.subtract.at(delta, self.stop[gone], 1)
        return np.cumsum(delta[:-1]) > 0

    def anchors(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the least grams of wanted windows, these grams' names).

        A least hash is a small one and shards are ranges, so a gram's name is its hash mixed once more.
        """
        span = self.window - GRAM + 1
        n = len(self.raw) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        eight = _eight(self.raw)
        gram = mix(mix(eight[: n + span - 1] * _P ^ (eight[8 : n + span + 7] * _Q + _R)) ^ eight[GRAM - 8 : n + span + GRAM - 9] * _R)
        del eight
        least = sliding(np.minimum, gram, span)
        lined = np.zeros(n + 2 * (span - 1), np.uint64)
        lined[span - 1 : span - 1 + n] = np.where(wanted[:n], least, 0)
        selected = np.flatnonzero((sliding(np.maximum, lined, span) == gram) & (gram > 0))
        return selected, mix(gram[selected])


def _eight(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; shorter ones at the buffer's end are filled up."""
    x = np.concatenate([raw, np.zeros(16, np.uint8)]).astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return x[:-4] << np.uint64(32) | x[4:]


def triggers(eight: np.ndarray, bits: int) -> np.ndarray:
    """Places whose next eight bytes hash to zero in the given number of bits."""
    n = len(eight) - 9
    return ((eight[:n] ^ (eight[:n] >> np.uint64(29))) * _P) >> np.uint64(64 - bits) == 0


def least_of(h1: np.ndarray, h2: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct h1 in order, their h2, the smallest value of each)."""
    if not len(h1):
        return h1, h2, value
    order, first = X.grouped(h1, h2)
    return h1[order][first], h2[order][first], np.minimum.reduceat(value[order], first)


def meet(asked1: np.ndarray, asked2: np.ndarray, *tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value that the tables have for each asked string."""
    out = np.full(len(asked1), _NONE)
    for h1, h2, value in tables:
        if len(h1):
            at = X.found(h1, h2, asked1, asked2)
            out = np.where(at >= 0, np.minimum(out, value[at]), out)
    return out


def contexts(chunk: Chunk, places: np.ndarray, gram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, hashes) of the text around anchors: all that windows with the anchor can hold, and its document.

    Bytes beyond the document are zero, and left and right say how many there are within it.
    """
    side = window - GRAM
    out = np.zeros(len(places), context_type(window))
    doc = chunk.doc_of(places)
    out["id"] = chunk.id[doc]
    out["left"] = np.minimum(places - chunk.offsets[:-1][doc], side)
    out["right"] = np.minimum(chunk.offsets[1:][doc] - places - GRAM, side)
    width = GRAM + 2 * side
    padded = np.concatenate([np.zeros(side, np.uint8), chunk.raw, np.zeros(side + GRAM, np.uint8)])
    text = np.lib.stride_tricks.sliding_window_view(padded, width)[places].copy()
    column = np.arange(width)
    text[(column < side - out["left"][:, None]) | (column >= side + GRAM + out["right"][:, None])] = 0
    out["text"] = text
    return out, _row_hash(text, mix(gram ^ out["left"].astype(np.uint64) * _P ^ out["right"].astype(np.uint64) * _Q))


def _row_hash(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes h with a row of bytes mixed into each."""
    words = np.ascontiguousarray(np.pad(text, ((0, 0), (0, -text.shape[1] % 8)))).view(np.uint64)
    for i in range(words.shape[1]):
        h = mix(h ^ words[:, i] * _R)
    return h


def context_type(window: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("left", "u1"), ("right", "u1"), ("text", "u1", (2 * window - GRAM,))])


def every_window(left: np.ndarray, right: np.ndarray, window: int) -> np.ndarray:
    """Contexts x how far a window begins before the anchor: whether that window is within the document."""
    back = np.arange(window - GRAM + 1)
    return (left[:, None] >= back) & (right[:, None] >= window - GRAM - back)


def earlier_windows(window: int) -> X.Decision:
    """Of each context, the windows (a bit each, by how far they begin before the anchor) that a smaller id holds."""

    def decision(gram: np.ndarray, h: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = _decided(entry, gram, 0, window - GRAM, window)
        tidy()
        chosen = np.flatnonzero(mask)
        return chosen, mask[chosen]

    return decision


def _decided(entry: np.ndarray, key: np.ndarray, low: int, high: int, window: int) -> np.ndarray:
    """The decision for contexts whose windows begin low to high bytes before the anchor, equal ones under equal keys."""
    mask = np.zeros(len(key), np.int64)
    by = np.argsort(key, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(key[by], prepend=~key[by[:1]])), len(key))
    at = 0
    while at < len(key):  # contexts with one key stay together
        end = int(edges[max(np.searchsorted(edges, at + SORTED_AT_ONCE, "right") - 1, np.searchsorted(edges, at, "right"))])
        rows = by[at:end]
        if len(rows) <= SORTED_AT_ONCE:
            mask[rows] = _ordered(entry[rows], window)
        elif low < high:
            mask[rows] = _by_longer_keys(entry[rows], low, high, window)
        else:
            mask[rows] = _in_turn(entry[rows], low, window)
        at = end
    return mask


def _by_longer_keys(entry: np.ndarray, low: int, high: int, window: int) -> np.ndarray:
    """The decision for too many contexts under one key: half of the windows at a time, which share more bytes than the key's."""
    side = window - GRAM
    middle = (low + high) // 2
    mask = np.zeros(len(entry), np.int64)
    for a, b in ((low, middle), (middle + 1, high)):
        left, right = np.minimum(entry["left"], b), np.minimum(entry["right"], side - a)
        some = np.flatnonzero(left.astype(np.int64) + right >= side)
        shared = entry["text"][some][:, side - a : window + side - b]  # in each of these windows
        key = _row_hash(shared, np.zeros(len(some), np.uint64))
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        several = count[number] > 1
        some = some[several]
        part = entry[some]
        part["left"], part["right"] = left[some], right[some]
        mask[some] |= _decided(part, key[several], a, b, window)
    return mask


def _in_turn(entry: np.ndarray, back: int, window: int) -> np.ndarray:
    """The decision for any number of contexts of one window each, smaller ids first: what they begin with stays for the others."""
    side = window - GRAM
    mask = np.zeros(len(entry), np.int64)
    by = np.argsort(entry["id"], kind="stable")
    first = by[:0]
    for at in range(0, len(by), SORTED_AT_ONCE):
        rows = np.concatenate([first, by[at : at + SORTED_AT_ONCE]])
        mask[rows] = _ordered(entry[rows], window)
        new = rows[mask[rows] == 0]
        _, one = np.unique(np.ascontiguousarray(entry["text"][new][:, side - back : side - back + window]), axis=0, return_index=True)
        first = new[one]
    return mask


def _ordered(entry: np.ndarray, window: int) -> np.ndarray:
    """The decision for some contexts, from the order of the suffixes that begin with a window."""
    side, width = window - GRAM, 2 * window - GRAM
    column = np.arange(width)
    left, right = entry["left"].astype(np.int64), entry["right"].astype(np.int64)
    inside = (column >= side - left[:, None]) & (column < side + GRAM + right[:, None])
    symbols = entry["text"][inside]
    size = left + GRAM + right
    begins = np.zeros((len(entry), width), bool)
    begins[:, : side + 1] = every_window(left, right, window)[:, ::-1]
    owner, place = np.nonzero(begins)
    wanted = begins[inside]
    if not len(owner):
        return np.zeros(len(entry), np.int64)
    eight = _eight(symbols)
    order = prefix_free_order(symbols, np.repeat(np.cumsum(size), size), triggers(eight, PARSE_BITS), TRIGGER, wanted)
    same = np.ones(len(order) - 1, bool)  # neighbours that share a whole window
    for k in [*range(0, window - 8, 8), window - 8]:
        x = eight[order + k]
        same &= x[1:] == x[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    number = (np.cumsum(wanted) - 1)[order]  # of the windows, context by context
    id_ = entry["id"][owner[number]]
    least = np.repeat(np.minimum.reduceat(id_, first), np.diff(np.append(first, len(order))))
    hit = number[least < id_]
    held = np.zeros((len(entry), side + 1), np.int64)
    held[owner[hit], side - place[hit]] = 1
    return held @ (np.int64(1) << np.arange(side + 1, dtype=np.int64))


class Block:
    """A block's chunks and what the shards have told it so far, by kind."""

    def __init__(self, table: pa.Table, told: pa.Table | None, window: int):
        self.window = window
        self.chunks = [Chunk(b, window) for b in X.one_block(table, CHUNK)]
        self.told: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for kind in (0, 1, 2):
            part = told.filter(pa.compute.equal(told.column("kind"), kind)) if told is not None else X.empty_ask()
            h1, h2, value, _ = X.unpacked(part, np.int64)
            order = np.lexsort((h2, h1))
            self.told[kind] = h1[order], h2[order], value[order]

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return least_of(*(np.concatenate([getattr(c, x) for c in self.chunks]) for x in ("h1", "h2", "holder")))

    def first_held(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(copied windows, windows of phrases that no smaller id holds) of each chunk."""
        own = self.phrases()
        out = []
        for c in self.chunks:
            copied = c.copied(meet(c.h1, c.h2, own, self.told[0]))
            out.append((copied, c.valid() & ~copied))
        return out

    def candidates(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(copied windows, places of the anchors of other windows that another document holds too, their grams) of each chunk."""
        out = []
        for c, (copied, wanted) in zip(self.chunks, self.first_held(), strict=True):
            places, gram = c.anchors(wanted)
            hit = np.isin(gram, self.told[1][0])
            out.append((copied, places[hit], gram[hit]))
        return out


def remove_earlier_bytes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """Per row: its bytes, the number removed, the kept bytes and the removed byte ranges; then the columns to carry, as carried_0, carried_1, ...

    A byte goes if a string of `window` bytes that covers it also starts in a document of smaller id.
    A row's other columns come along, as an id that is null or repeated does not find its row again.
    as_text: what is kept is a string, without characters of which a byte goes. That is done here, as a
    step in Python after this one would hold a second worker for each task.
    """
    if not 2 * GRAM <= window < GRAM + 63:
        raise ValueError(f"windows need {2 * GRAM} to {GRAM + 62} bytes")
    n = X.blocks_for(X.text_bytes(docs, text), block_bytes)
    dealt = X.in_blocks(docs, id_col, text, n, carry)
    types = StructType([*StructType.fromDDL(OUT.replace("kept binary", "kept string") if as_text else OUT), *(f for f in dealt.schema if f.name.startswith("carried_"))])
    own = _OUT.set(_OUT.get_field_index("kept"), pa.field("kept", pa.string())) if as_text else _OUT
    schema = pa.schema([*own, *list(to_arrow_schema(types))[len(own) :]])

    def tidied(asked: pa.Table) -> pa.Table:
        tidy()
        return asked

    def ask_phrases(table: pa.Table) -> pa.Table:
        return tidied(X.packed(table.column("block")[0].as_py(), n, 0, *Block(table, None, window).phrases()))

    def ask_anchors(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.empty_ask()
        block = Block(table, told, window)
        grams, ids = [], []
        for c, (_, wanted) in zip(block.chunks, block.first_held(), strict=True):
            places, gram = c.anchors(wanted)
            grams.append(gram)
            ids.append(c.id[c.doc_of(places)])
        gram, id_ = np.concatenate(grams), np.concatenate(ids)
        order = np.argsort(gram, kind="stable")
        gram, id_ = gram[order], id_[order]
        first = np.flatnonzero(np.diff(gram, prepend=~gram[:1]))
        several = np.minimum.reduceat(id_, first) != np.maximum.reduceat(id_, first) if len(first) else np.zeros(0, bool)
        return tidied(X.packed(table.column("block")[0].as_py(), n, 1, gram[first], np.zeros(len(first), np.uint64), several.astype(np.int64)))

    def left_over(block: Block) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """The candidates by chunk; then of all of the block's contexts, one each: gram, hash, entry with the smallest id."""
        found = block.candidates()
        around = [(gram, *contexts(c, places, gram, window)) for c, (_, places, gram) in zip(block.chunks, found, strict=True)]
        gram, entry, h = (np.concatenate([x[i] for x in around]) for i in range(3))
        order, first = X.grouped(gram, h)
        one = order[first]
        distinct = entry[one]
        if len(first):
            distinct["id"] = np.minimum.reduceat(entry["id"][order], first)
        return [(*f, x[2], x[1]) for f, x in zip(found, around, strict=True)], gram[one], h[one], distinct

    def ask_windows(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.empty_ask()
        return tidied(X.packed(table.column("block")[0].as_py(), n, 2, *left_over(Block(table, told, window))[1:]))

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        block = Block(table, told, window)
        found, gram, h, distinct = left_over(block)
        h1, h2, mask = block.told[2]
        at = X.found(h1, h2, gram, h)
        told_mask = np.where(at >= 0, mask[at], 0) if len(mask) else np.zeros(len(gram), np.int64)
        bits = np.int64(1) << np.arange(window - GRAM + 1, dtype=np.int64)
        out = []
        for c, (copied, places, own, own_h, entry) in zip(block.chunks, found, strict=True):
            at = X.found(gram, h, own, own_h)
            later = entry["id"] > distinct["id"][at]  # a smaller id of this very block holds all of the context
            held = np.where(later, every_window(entry["left"], entry["right"], window) @ bits, told_mask[at])
            gone = [np.flatnonzero(copied), *(places[held & bit > 0] - back for back, bit in enumerate(bits))]
            out.append(_kept(c, cover(np.concatenate(gone), window, len(c.raw)), schema))
        tidy()
        return pa.concat_tables(out)

    def smallest(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(np.append(first, len(value)))
        least = np.minimum.reduceat(value, first) if len(first) else value
        return np.repeat(size > 1, size), np.repeat(least, size)

    def shared(several: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(np.append(first, len(several)))
        hit = (size > 1) | (np.maximum.reduceat(several, first) > 0 if len(first) else False)
        return np.repeat(hit, size), several

    by_block = dealt.groupBy("block")
    phrases = X.answers(by_block.applyInArrow(ask_phrases, X.ASK), np.int64, X.by_string(smallest))
    anchors = X.answers(by_block.cogroup(phrases.groupBy("block")).applyInArrow(ask_anchors, X.ASK), np.int64, X.by_string(shared))
    known = phrases.unionByName(anchors)
    windows = X.answers(by_block.cogroup(known.groupBy("block")).applyInArrow(ask_windows, X.ASK), context_type(window), earlier_windows(window))
    return by_block.cogroup(known.unionByName(windows).groupBy("block")).applyInArrow(finish, types)


def _kept(c: Chunk, gone: np.ndarray, schema: pa.Schema) -> pa.Table:
    n_docs = len(c.offsets) - 1
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[c.offsets[1:]] - total[c.offsets[:-1]]
    ends = (c.offsets - total[c.offsets]).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), n_docs, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(c.raw[~gone].tobytes())])
    if schema.field("kept").type == pa.string():
        kept = pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())
    border = np.zeros(len(gone) + 1, bool)
    border[c.offsets] = True
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    s = np.flatnonzero(gone & (~before | border[:-1]))
    e = np.flatnonzero(gone & (~after | border[1:])) + 1
    owner = c.doc_of(s)
    spans = pa.StructArray.from_arrays([pa.array((s - c.offsets[owner]).astype(np.int32)), pa.array((e - c.offsets[owner]).astype(np.int32))], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32)), spans)
    return pa.table([c.ids, pa.array(np.diff(c.offsets)), pa.array(removed), kept, lists, *c.carried], schema=schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = remove_earlier_bytes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as p from documents),
b1 as (select r, unnest(p) as x1, generate_subscripts(p, 1) as k from d),
b2 as (select *, x1 || lead(x1, 1) over w as x2 from b1 window w as (partition by r order by k)),
b4 as (select *, x2 || lead(x2, 2) over w as x4 from b2 window w as (partition by r order by k)),
b8 as (select r, k, x1, x2, x4 || lead(x4, 4) over w as x8 from b4 window w as (partition by r order by k)),
b16 as (select r, k, x1, x2, x8 || lead(x8, 8) over w as x16 from b8 window w as (partition by r order by k)),
b32 as (select *, x16 || lead(x16, 16) over w as x32 from b16 window w as (partition by r order by k)),
windows as (select r, k, x1 as b, x32 || lead(x16, 32) over w || lead(x2, 48) over w as x from b32 window w as (partition by r order by k)),
owned as (select doc_id, r, k, b, x from windows join (select r, doc_id from d) using (r)),
firsts as (select x, min(doc_id) as first_id from owned where x is not null group by x having min(doc_id) < max(doc_id)),
marked as (select r, k, b, coalesce(first_id < doc_id, false) as copied from owned left join firsts using (x)),
judged as (select r, k, b, max(case when copied then k end) over (partition by r order by k rows between 49 preceding and current row) is not null as gone from marked),
edged as (select *, gone and not coalesce(lag(gone) over (partition by r order by k), false) as begins from judged)
select doc_id, cast(len(p) as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join (select r, count(*) filter (where gone) as n_removed, count(*) filter (where begins) as n_spans, string_agg(b, '' order by k) filter (where not gone) as kept from edged group by r) using (r)
"""
