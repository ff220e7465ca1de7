"""Byte-pair encoding of whole texts and decoding of ids.

A word's symbols form a doubly linked list; a priority queue holds (merge rank, place) of adjacent
pairs, and an entry whose symbols have since merged away is stale and skipped when popped. Words
repeat, so each Python worker encodes the distinct words of a chunk of texts and keeps them in a
cache of bounded bytes, whose hits are held against the words' own bytes. Splitting, looking up and putting ids together are array operations.
Decoding looks the vocabulary string of each id up and concatenates, as the tokenizer's decoder does.

Defined results: a null text is an empty text with no ids; ids, nulls and repeated rows of other
columns pass through untouched; texts are never cut.
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import _P, gather, mix, range_hash, rows_of, tidied, unequal

CACHE_BYTES = 32 << 20
CHUNK = 1 << 20
#: Fixed value: the split pattern of word_bpe vocabularies, which split_points() follows.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Merges:
    """Ranks of the merges and ids of the symbols of one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None):
        self.vocab, self.suffix = vocab, suffix or ""
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def encode(self, symbols: list[str]) -> list[int]:
        """Ids of one word; a symbol that the vocabulary lacks is left out, as there is no unknown token."""
        if self.suffix and symbols:
            symbols[-1] += self.suffix
        get, rank = self.vocab.get, self.rank
        ids = [i for s in symbols if (i := get(s)) is not None]
        n = len(ids)
        if n < 2:
            return ids
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        queue = [(r[0], i, r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            order, i, made = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or (r := rank.get((ids[i], ids[j]))) is None or r[0] != order:
                continue  # stale: one of the pair has merged with another symbol
            ids[i], alive[j] = made, False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := rank.get((made, ids[k])):
                    heapq.heappush(queue, (r[0], i, r[1]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], made))):
                heapq.heappush(queue, (r[0], h, r[1]))
        return [x for x, on in zip(ids, alive, strict=True) if on]


LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
_SINGLE, _DOUBLE = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of each code point that the two split patterns tell apart; BLANK is U+0020, SPACE any other white space."""
    import regex

    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            first = ord(m[0][0])
            out[first : first + len(m[0])] = kind
    out[0x20] = BLANK
    return out


def split_points(chars: np.ndarray, offsets: np.ndarray, leading_blank: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of many texts, as the split patterns find them.

    leading_blank: the pattern of byte_bpe (a blank belongs to the word after it, white space is
    kept, digits run together); else that of word_bpe (white space is dropped, a digit is a word).
    """
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes()[chars]
    space = kind >= SPACE
    kind[space] = SPACE
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = border[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    if not leading_blank:
        start |= kind == NUMBER
    # contractions: an apostrophe at which a word would start, not after a blank that it belongs to
    quote = np.flatnonzero((chars == 0x27) & start)
    if leading_blank and len(quote):
        quote = quote[border[quote] | (chars[quote - 1] != 0x20)]
    if len(quote):
        end = offsets[np.searchsorted(offsets, quote, "right")]
        at = lambda k: np.where(quote + k < end, chars[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        size = np.where(np.isin(one, [ord(c) for c in _SINGLE]), 2, 0)
        for pair in _DOUBLE:
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
        quote, size, end = quote[size > 0], size[size > 0], end[size > 0]
        start[quote + 1] = False
        rest = (quote + size)[quote + size < end]
        start[rest] = True
    if leading_blank:
        follows = np.zeros(n, bool)  # white space right before something else of the same text
        follows[:-1] = space[:-1] & ~space[1:] & ~border[1:-1]
        start |= follows
        joined = follows & (chars == 0x20)
        start[1:] &= ~joined[:-1]
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], n)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    keep = ~space[starts]
    return starts[keep], ends[keep]


class WordCache:
    """Words with their ids, found by hash and told apart by their bytes; emptied when it has grown to `limit` bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.where = np.zeros((0, 4), np.int64)  # start and number of the ids, start and size of the bytes
        self.pool, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def lookup(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start and number of the ids in the pool, whether its bytes are another word's) of each word raw[start:start + size]; hashes are sorted and distinct."""
        if self.hash.nbytes + self.where.nbytes + self.pool.nbytes + self.raw.nbytes > self.limit:
            self.clear()
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
            missing = np.flatnonzero(self.hash[at] != hashes)
        else:
            missing = np.arange(len(hashes))
        if len(missing):
            ids, length = self.encoded(raw, start[missing], size[missing])
            n = size[missing]
            where = np.stack([len(self.pool) + np.cumsum(length) - length, length, len(self.raw) + np.cumsum(n) - n, n], axis=1)
            place = np.searchsorted(self.hash, hashes[missing])
            self.where, self.hash = np.insert(self.where, place, where, axis=0), np.insert(self.hash, place, hashes[missing])
            self.pool, self.raw = np.concatenate([self.pool, ids]), np.concatenate([self.raw, gather(raw, start[missing], n)])
        where = self.where[np.searchsorted(self.hash, hashes)]
        return where[:, :2], unequal(raw, start, size, self.raw, where[:, 2], where[:, 3])

    def encoded(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number) of words, without the cache."""
        made = self.encode([raw[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)])
        length = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(length.sum())), length


class Codec:
    """Encoder and decoder of a tokenizers file with a BPE model on byte-level symbols."""

    def __init__(self, path: str, library: bool = False):
        """library: encode each distinct word with the tokenizers library's own model."""
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"]
        split = next((x["pattern"]["Regex"] for x in pre.get("pretokenizers", []) if x["type"] == "Split"), None)
        if split not in (None, WORD_PATTERN) or not set(self.steps) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"no splitter for the pattern {split!r} after {self.steps}")
        self.leading_blank = split is None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_alphabet()
        if library:
            from tokenizers import Tokenizer

            tokenize = Tokenizer.from_file(path).model.tokenize
            self.words = WordCache(lambda words: [[t.id for t in tokenize("".join(letters[b] for b in w))] for w in words])
        else:
            merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
            self.words = WordCache(lambda words: [merges.encode([letters[b] for b in w]) for w in words])
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            tokens[i] = token.encode()
        self.joined = spec["decoder"] is None  # without a decoder, tokens are joined by spaces
        self.to_bytes = None if self.joined else {c: b for b, c in enumerate(letters)}
        if not self.joined:
            tokens = [t if s in self.special else bytes(self.to_bytes[c] for c in s) for t, s in ((t, t.decode()) for t in tokens)]
        lead = b" " if self.joined else b""
        self.lengths = np.array([len(lead + t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(lead + t for t in tokens), np.uint8)

    def normal(self, text: str) -> str:
        if not self.steps:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter alone: no final sigma
        return text.lower()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids); the strings of special tokens stand for themselves."""
        parts, owner, fixed = [], [], []
        for i, text in enumerate(texts):
            text = text or ""
            pieces = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            for piece in pieces:
                fixed.append(self.special.get(piece, -1) if len(pieces) > 1 else -1)
                parts.append("" if fixed[-1] >= 0 else self.normal(piece))
                owner.append(i)
        joined = "".join(parts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        starts, ends = split_points(chars, offsets, self.leading_blank)
        raw = np.frombuffer(joined.encode(), np.uint8)
        if len(raw) == len(chars):
            begin, size = starts, ends - starts
        else:
            place = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000), dtype=np.int64)])
            begin, size = place[starts], place[ends] - place[starts]
        hashes = mix(range_hash(raw, begin, begin + size, _P))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        one = first[inverse]
        odd = unequal(raw, begin, size, raw, begin[one], size[one])
        where, other = self.words.lookup(distinct, raw, begin[first], size[first])
        where, odd, pool = where[inverse], odd | other[inverse], self.words.pool
        if odd.any():  # words that share a hash with another one
            ids, length = self.words.encoded(raw, begin[odd], size[odd])
            where[odd, 0], where[odd, 1] = len(pool) + np.cumsum(length) - length, length
            pool = np.concatenate([pool, ids])
        length = where[:, 1]
        ids = gather(pool, where[:, 0], length)
        edges = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(starts, offsets)]
        fixed = np.array(fixed, np.int64)
        if (special := np.flatnonzero(fixed >= 0)).size:
            ids = np.insert(ids, edges[special], fixed[special].astype(np.uint32))
            edges = edges + np.concatenate([[0], np.cumsum(fixed >= 0)])
        return ids, edges[np.searchsorted(owner, np.arange(len(texts) + 1))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids: the vocabulary's strings, one after another."""
        length = self.lengths[ids]
        data = gather(self.pool, self.starts[ids], length).tobytes()
        at = np.concatenate([[0], np.cumsum(length)])[offsets].tolist()
        skip = int(self.joined)
        return [data[a + skip : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(at, at[1:], strict=False)]


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, library: bool = False) -> Codec:
    """One codec a Python worker and vocabulary file, so that its cache lives on between batches."""
    if (path, library) not in _codecs:
        _codecs[path, library] = Codec(path, library)
    return _codecs[path, library]


def binary_slices(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each run of ids as packed little-endian unsigned 32-bit integers."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


_OUT = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids as packed little-endian unsigned 32-bit integers, decoded text) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in rows_of(batches, "text", CHUNK):
            ids, at = c.encode(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("id"), binary_slices(ids, at), pa.array(c.decode(ids, at), pa.string())], schema=_OUT)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(tidied(run), "id long, ids binary, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
