"""Vectorised text primitives shared by the corpus operators.

A batch of texts is handled as one UTF-8 byte buffer with document offsets, so that words,
shingles and windows of all its documents are numpy arrays and no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK_BYTES = 1 << 19
U64 = np.uint64
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3  # fixed values of glibc's mallopt
_P, _Q, _R = (U64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


PRIME = U64((1 << 61) - 1)
SPAN = 1 << 16  # places that one table of powers covers
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    y = x & PRIME
    y += x >> U64(61)
    return np.minimum(y, y - PRIME, out=y)  # below the prime, the difference wraps around and is larger


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for factors below that."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    out = a1 * b1
    out <<= U64(1)
    a1 *= b0
    b1 *= a0
    a1 += b1
    a0 *= b0
    out += a0
    out += a1 >> U64(30)
    a1 &= _LOW30
    a1 <<= U64(31)
    out += a1
    return reduced(out)


@lru_cache(maxsize=4)
def _tables(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper and lower bits of the powers of the base, powers of its inverse), SPAN of each."""
    base %= int(PRIME)

    def powers(x: int) -> np.ndarray:
        out = np.ones(1, U64)
        while len(out) < SPAN:
            out = np.concatenate([out, times(out, np.full(len(out), pow(x, len(out), int(PRIME)), U64))])
        return out

    up = powers(base)
    return up >> U64(31), up & _LOW31, powers(pow(base, -1, int(PRIME)))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash modulo the prime 2**61 - 1 of values[s:e] for each pair, independent of the place.

    Bytes are taken as they are; other values are 64-bit numbers, which count modulo the prime.
    """
    n = len(values)
    if not n or not len(starts):
        return np.zeros(len(starts), U64)
    upper, lower, inverse = _tables(int(base))
    spans = -(-n // SPAN)
    high, low = np.empty(n, U64), np.empty(n, U64)
    for k in range(spans):
        a, b = k * SPAN, min(n, (k + 1) * SPAN)
        if values.dtype == np.uint8:
            v = values[a:b].astype(U64) + U64(1)
            np.cumsum(v * upper[: b - a], out=high[a:b])
            np.cumsum(v * lower[: b - a], out=low[a:b])
        else:
            v = times(reduced(values[a:b]), upper[: b - a] << U64(31) | lower[: b - a])
            np.cumsum(v >> U64(31), out=high[a:b])
            np.cumsum(v & _LOW31, out=low[a:b])

    def total(at: np.ndarray) -> np.ndarray:
        """The sum up to each place, it included, since its span began."""
        x = reduced(high[at])
        return reduced(((x << U64(31)) & PRIME) + (x >> U64(30)) + reduced(low[at]))

    p, step = int(PRIME), pow(int(base), SPAN, int(PRIME))
    big = np.array([pow(step, k, p) for k in range(spans)], U64)
    small = np.array([pow(step, -k, p) for k in range(spans)], U64)
    sums = times(total(np.minimum(np.arange(1, spans + 1) * SPAN, n) - 1), big)
    before = np.zeros(spans, U64)
    for k in range(1, spans):
        before[k] = (int(before[k - 1]) + int(sums[k - 1])) % p

    def prefix(at: np.ndarray) -> np.ndarray:
        """The sum of all places before each."""
        last = np.maximum(at - 1, 0)
        x = total(last)
        if spans > 1:
            x = reduced(times(x, big[last // SPAN]) + before[last // SPAN])
        x[at == 0] = 0
        return x

    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    x = times(reduced(prefix(ends) + (PRIME - prefix(starts))), inverse[starts % SPAN])
    return times(x, small[starts // SPAN]) if spans > 1 else x


def _glibc() -> ctypes.CDLL | None:
    try:
        library = ctypes.CDLL(None)
        return library if hasattr(library, "mallopt") and hasattr(library, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _glibc()
if _LIBC is not None:  # arrays of a few MB come and go all the time: their pages stay until tidy()
    _LIBC.mallopt(_M_MMAP_THRESHOLD, 16 << 20)
    _LIBC.mallopt(_M_TRIM_THRESHOLD, 64 << 20)


def tidy() -> None:
    """Give memory that a task no longer needs back to the machine, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidied(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, a generator over a task's batches, with tidy() at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def rows_of(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together hold about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffer_of(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return raw, offsets - base


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts.

    start, end: byte range of each word; doc: index of its text; first: index of each text's
    first word, with one more at the end; code: a 64-bit hash of each word's bytes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, codes: bool = True):
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.raw, self.offsets = raw, offsets
        inside = ~SEPARATORS[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(raw) + 1, bool)
        before[0] = False
        before[1:] = inside
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(len(raw) + 1, bool)
        after[-1] = False
        after[:-1] = inside
        after[edge] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if codes:
            self.code = mix(range_hash(raw, self.start, self.end, _P))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of k words that stay inside one text."""
        n = len(self.code) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(range_hash(self.code, at, at + k, _Q))


def sliding(ufunc: np.ufunc, values: np.ndarray, w: int) -> np.ndarray:
    """ufunc over values[i:i+w] for each i, by doubling spans."""
    out, span = values, 1
    while span < w:
        step = min(span, w - span)
        out = ufunc(out[:-step], out[step:])
        span += step
    return out


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for any of the starts."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.subtract.at(delta, np.minimum(starts + width, n), 1)
    return np.cumsum(delta[:-1]) > 0


def gather(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """raw[s:s+l] of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, raw.dtype)
    begin = np.cumsum(lengths) - lengths
    return raw[np.arange(total) + np.repeat(starts - begin, lengths)]


def unequal(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which of the pairs of byte ranges differ."""
    out = a_size != b_size
    same = np.flatnonzero(~out)
    size = a_size[same]
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum()))
    wrong = np.flatnonzero(a[place + np.repeat(a_start[same] - begin, size)] != b[place + np.repeat(b_start[same] - begin, size)])
    out[same[np.searchsorted(begin, wrong, "right") - 1]] = True
    return out
