"""Exact removal of repeated word windows, prefiltered by a count-min sketch.

Pass one: every window of `window` words is represented by its anchor, the least-hashed shingle of
half its words; equal windows at different places have equal anchors at different places, so an
anchor is counted at least as often as any of its windows. Each block of documents counts its anchors
in a count-min sketch; the merged sketch overestimates, so a window whose anchor is estimated below
two occurs once and is dropped from all further work. Pass two groups the remaining windows exactly,
by two independent hashes of 61 bits each.

The merged sketch lives in shards, `cells` cells a row in each, as many shards as blocks: nothing is
broadcast or gathered, and the load of a cell is the same at any size of the corpus. A sketch that is
too full for its keys lets more windows through to the exact pass; it loses none.

Defined results: a null text has no words; a null id is kept as an id of its own row; repeated rows
are separate documents, so their windows repeat each other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .sketch import ROWS, Estimates, block_sketch, merged
from .text import _P, _Q, _R, Words, buffer_of, cover, gather, mix, range_hash, sliding, tidy

WINDOW = 35
BLOCK_BYTES = 4 << 20
CELLS = 1 << 19  # of a shard and row: about eight for each anchor of a block's bytes
OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, each window's least shingle hash, hashes of all places that are a least one)."""
    k = window // 2 + 1
    w = window - k + 1
    n = len(words.code) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.arange(len(words.code) - k + 1)
    shingle = mix(range_hash(words.code, at, at + k, _Q))
    least = sliding(np.minimum, shingle, w)
    inside = words.doc[:n] == words.doc[window - 1 :]
    lined = np.zeros(n + 2 * (w - 1), np.uint64)  # windows across texts select nothing
    lined[w - 1 : w - 1 + n] = np.where(inside, least, 0)
    selected = sliding(np.maximum, lined, w) == shingle
    starts = np.flatnonzero(inside)
    return starts, least[starts], shingle[selected & (shingle > 0)]


class Block:
    """A block's words and anchors, chunk by chunk, and what the sketch lets through."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.chunks = []
        for batch in X.one_block(table):
            words = Words(*buffer_of(batch.column("text")))
            self.chunks.append((batch, words, *anchors(words, window)))

    def keys(self) -> np.ndarray:
        """The hashes of all places that are anchors."""
        return np.concatenate([np.zeros(0, np.uint64), *(at for *_, at in self.chunks)])

    def candidates(self, told: pa.Table, shards: int, cells: int):
        """(batch, words, starts and two hashes of the windows that may be repeated) of each chunk."""
        estimates = Estimates(self.keys(), told, shards, cells)
        for batch, words, starts, least, _ in self.chunks:
            if len(starts):
                run = np.flatnonzero(np.diff(least, prepend=~least[0]))
                starts = starts[np.repeat(estimates.repeated(least[run]), np.diff(np.append(run, len(least))))]
            yield batch, words, starts, *window_hashes(words, starts, self.window)


def window_hashes(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window, by two independent hashes of its words. Other words are not looked at."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    inside = np.flatnonzero(cover(starts, window, len(words.start)))
    at = np.searchsorted(inside, starts)
    size = (words.end - words.start)[inside]
    begin = np.cumsum(size) - size
    second = mix(range_hash(gather(words.raw, words.start[inside], size), begin, begin + size, _R))
    return mix(range_hash(words.code[inside], at, at + window, _P)), mix(range_hash(second, at, at + window, _Q))


def remove_repeated_windows(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, cells: int = CELLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, the number removed, the kept words joined by one space, and the removed word ranges.

    A word goes if a window of `window` words of its document that covers it also starts at any
    other place of the corpus.
    """
    n = X.blocks_for(X.text_bytes(docs, text), block_bytes)
    dealt = X.in_blocks(docs, id_col, text, n)

    def sketch(table: pa.Table) -> pa.Table:
        return block_sketch(table.column("block")[0].as_py(), Block(table, window).keys(), n, cells)

    def ask(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.empty_ask()
        found = [x[3:] for x in Block(table, window).candidates(told, n, cells)]
        h1, h2 = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        if not len(h1):
            return X.empty_ask()
        order, first = X.grouped(h1, h2)
        count = np.minimum(np.diff(np.append(first, len(order))), 2)
        return X.packed(table.column("block")[0].as_py(), n, ROWS, h1[order][first], h2[order][first], count.astype(np.uint8))

    def repeated(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.add.reduceat(count.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        keep = np.repeat(total > 1, np.diff(np.append(first, len(count))))
        return keep, np.zeros(len(count), np.uint8)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SCHEMA.empty_table()
        h1, h2, _, _ = X.unpacked(told.filter(pa.compute.equal(told.column("kind"), ROWS)), np.uint8)
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        out = []
        for batch, words, starts, a, b in Block(table, window).candidates(told, n, cells):
            hit = starts[X.found(h1, h2, a, b) >= 0]
            gone = cover(hit, window, len(words.start))
            out.append(_kept(batch.column("id"), words, gone))
        tidy()
        return pa.concat_tables(out)

    by_block = dealt.groupBy("block")
    estimates = merged(by_block.applyInArrow(sketch, X.ASK), cells)
    windows = X.answers(by_block.cogroup(estimates.groupBy("block")).applyInArrow(ask, X.ASK), np.uint8, X.by_string(repeated))
    return by_block.cogroup(estimates.unionByName(windows).groupBy("block")).applyInArrow(finish, OUT)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _kept(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.Table:
    first = words.first
    n_docs = len(first) - 1
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[first[1:]] - total[first[:-1]]
    # the kept words' bytes, with a space before each but a document's first
    keep = np.flatnonzero(~gone)
    length = words.end[keep] - words.start[keep]
    doc = words.doc[keep]
    lead = np.ones(len(keep), np.int64)
    lead[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
    size = length + lead
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.full(int(at[-1]), 0x20, np.uint8)
    if len(keep):
        place = np.arange(int(length.sum()))
        shift = np.repeat(np.cumsum(length) - length, length)
        data[np.repeat(at[:-1] + lead, length) + place - shift] = words.raw[np.repeat(words.start[keep], length) + place - shift]
    ends = at[np.searchsorted(doc, np.arange(n_docs + 1))]
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_docs, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    border = np.zeros(len(gone) + 1, bool)
    border[first[:-1]] = True
    inner = np.flatnonzero(border[1:-1] & gone[1:] & gone[:-1]) + 1 if len(gone) > 1 else np.zeros(0, np.int64)
    s = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
    e = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
    owner = words.doc[s] if len(s) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array((s - first[owner]).astype(np.int32)), pa.array((e - first[owner]).astype(np.int32))], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n_docs + 1)).astype(np.int32)), spans)
    return pa.table([ids.cast(pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), text.cast(pa.large_string()).cast(pa.string()), lists], schema=_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_windows(spark, docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select r, unnest(range(1, len(w) - 33)) as i from d),
windows as (select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as x from starts join d using (r)),
again as (select r, i from windows where x in (select x from windows group by x having count(*) > 1)),
words as (select r, unnest(w) as x, generate_subscripts(w, 1) as k from d),
judged as (select words.r, k, x, max(i) over (partition by words.r order by k rows between 34 preceding and current row) is not null as gone from words left join again on again.r = words.r and again.i = words.k)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join (select r, count(*) filter (where gone) as n_removed, string_agg(x, ' ' order by k) filter (where not gone) as kept from judged group by r) using (r)
"""
