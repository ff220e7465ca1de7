"""Quality rules for documents, with repetition found by suffix arrays.

The words of a chunk of texts are one sequence; its suffix array is built by prefix doubling, each
text's suffixes apart. The longest common prefix of neighbours follows from the ranks of each
doubling round. A suffix's longest repeat is the larger prefix it shares with a neighbour; the spans
of all maximal repeated substrings (the intervals of the longest-common-prefix array) together cover
the same words as the longest repeats of all suffixes, overlaps included.

Verdict: a document fails if spans of repeats of at least `min_words` words cover more than
`max_covered` of its words, or if its longest repeat has more than `max_longest` words. The base
rules fail a document of under `min_total` words, or one with over 30 % of its words in repeated
8-word windows. The verdict's own limits look where these do not: `min_words` is below 8, so that
words or short phrases said again and again count, and `max_longest` fails a passage that comes twice
in a text too long for it to be 30 %.

Defined results: a null or empty text has no words and fails; ids may be null or repeated, each row
is judged by itself; whole texts are used whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .suffix import common_prefixes, suffix_order
from .text import _P, Words, buffer_of, range_hash, rows_of, tidied, unequal

REPEAT_WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    min_total: int = 20
    repeat_percent: int = 30
    min_words: int = 4
    max_covered: float = 0.5
    max_longest: int = 50


def longest_repeats(words: Words) -> np.ndarray:
    """For each word, the length of the longest word sequence from it on that its document holds elsewhere too."""
    end = words.first[1:][words.doc]
    order, ranks = suffix_order(words.code, end, words.doc)
    lcp = common_prefixes(order, ranks, end)
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lcp[:-1], lcp[1:]) if len(order) else 0
    return out


def covered_by(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least `least` words."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at, 1)
    np.subtract.at(delta, at + longest[at], 1)
    return np.cumsum(delta[:-1]) > 0


def per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def duplicate_lines(words: Words) -> np.ndarray:
    """Per text: lines that hold a word and equal an earlier line."""
    raw, offsets = words.raw, words.offsets
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = starts[starts < len(raw)]
    text = np.searchsorted(offsets, starts, "right") - 1
    stop = np.append(starts[1:], len(raw))
    ends = np.where((raw[stop - 1] == 10) & (stop > starts), stop - 1, stop) if len(starts) else stop[:0]
    with_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, text = starts[with_word], ends[with_word], text[with_word]
    size = ends - starts
    code = range_hash(raw, starts, ends, _P)
    order = np.lexsort((code, text))
    again = np.zeros(len(order), bool)
    again[1:] = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    line = np.flatnonzero(again)
    a, b = order[line], order[line - 1]
    odd = set(text[a[unequal(raw, starts[a], size[a], raw, starts[b], size[b])]].tolist())
    out = np.bincount(text[order][again], minlength=len(offsets) - 1).astype(np.int64)
    for t in odd:  # different lines share a hash
        lines = [raw[starts[i] : ends[i]].tobytes() for i in np.flatnonzero(text == t)]
        out[t] = len(lines) - len(set(lines))
    return out


_OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_covered_words", pa.int64()), ("longest_repeat", pa.int64())])
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"


def judge(ids: pa.Array, raw: np.ndarray, offsets: np.ndarray, limits: Limits) -> pa.RecordBatch:
    words = Words(raw, offsets)
    n_words = np.diff(words.first).astype(np.int64)
    longest = longest_repeats(words)
    repeat = per_text(covered_by(longest, REPEAT_WINDOW), words.first)
    covered = per_text(covered_by(longest, limits.min_words), words.first)
    most = np.zeros(len(n_words), np.int64)
    if len(longest):
        np.maximum.at(most, words.doc, longest)
    inside = np.zeros(len(raw) + 1, np.int32)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    in_word = np.cumsum(inside[:-1]) > 0
    chars = per_text(in_word & ((raw & 0xC0) != 0x80), offsets)
    failed = (n_words < limits.min_total) | (100 * repeat > limits.repeat_percent * n_words)
    kept = ~failed & (covered <= limits.max_covered * n_words) & (most <= limits.max_longest)
    columns = [n_words, chars, per_text(_SYMBOL[raw], offsets), duplicate_lines(words), repeat, failed, kept, covered, most]
    return pa.record_batch([ids.cast(pa.int64()), *map(pa.array, columns)], schema=_OUT)


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The counts, the verdict, the words covered by repeats and the longest repeat of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            yield judge(batch.column("id"), *buffer_of(batch.column("text")), limits)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows, all columns as they are, that pass the rules."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, text):
            verdict = judge(pa.nulls(batch.num_rows, pa.int64()), *buffer_of(batch.column(text)), limits)
            yield batch.filter(verdict.column("kept"))

    return docs.mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words")


def _covered(n: int) -> str:
    """SQL for the words of each text that lie in a window of n words that the text holds twice."""
    return f"select r, count(*) as n from (select r, max(case when again then k end) over (partition by r order by k rows between {n - 1} preceding and current row) is not null as inside from (select r, k, x is not null and count(*) over (partition by r, x) > 1 as again from (select r, k, case when k + {n - 1} <= len(w) then array_to_string(list_slice(w, k, k + {n - 1}), ' ') end as x from words join d using (r)))) where inside group by r"


ORACLE = (
    r"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select r, generate_subscripts(w, 1) as k from d),
base8 as ("""
    + _covered(8)
    + "), base4 as ("
    + _covered(4)
    + "), base51 as ("
    + _covered(51)
    + r"""),
lines as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
q as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(lines.n, 0) as n_dup_lines, coalesce(base8.n, 0) as n_repeat_words, coalesce(base4.n, 0) as n_covered_words, base51.n is not null as too_long
from d left join lines using (r) left join base8 using (r) left join base4 using (r) left join base51 using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
 not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_covered_words <= 0.5 * n_words and not too_long as kept, n_covered_words from q
"""
)
