"""Language identification by multilingual mixture inference.

A document is taken as drawn from a mixture of languages. Each language has a smoothed distribution
of hashed letter trigrams, counted over all training documents. Expectation-maximisation estimates
the document's language proportions from its trigram counts; among the nested sets of its most
likely languages, from one language on, sets grow while the penalised likelihood does; the last that
was better is selected, with its own proportions. The prediction is the language with the largest
proportion, the score that proportion.

The model is one count vector of 2**16 for each language (0.5 MB), which goes to the driver and to all
executors: `max_languages` bounds it, and labels beyond that are an error, not languages left out.

Defined results: a null text or one without a letter is `und` with score 0, as is every text when no
document can be learned from; documents with a null text, language or id are not learned from; a
null id is not held out; repeated rows are learned from and judged one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import buffer_of, rows_of, tidied

BUCKETS = 1 << 16
_PARTS = 16
MAX_LANGUAGES = 256
UND = "und"
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every trigram of letters and word borders, in text order."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = _FOLD[raw]
    before, after = np.empty_like(here), np.empty_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    some = np.diff(offsets) > 0
    before[offsets[:-1][some]] = 0x20
    after[offsets[1:][some] - 1] = 0x20
    keep = here != 0x20
    code = (before << 16 | here << 8 | after)[keep]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    return text, ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = (_FOLD[raw] != 0x20) & (raw < 0x80)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Model:
    languages: list[str]
    counts: np.ndarray  # languages x buckets
    smoothing: float = 0.1

    def table(self) -> np.ndarray:
        """buckets x languages, probabilities."""
        c = self.counts.T + self.smoothing
        return c / c.sum(axis=0)


_COUNTS = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("counts", pa.binary())])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = MAX_LANGUAGES) -> Model:
    """Trigram counts of each language over all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in rows_of(batches, "text"):
            names = batch.column("lang").dictionary_encode()
            which = names.indices.to_numpy()
            at, gram = trigrams(*buffer_of(batch.column("text")))
            both = np.bincount(which[at] * BUCKETS + gram, minlength=len(names.dictionary) * BUCKETS).reshape(-1, BUCKETS)
            for name, row in zip(names.dictionary.to_pylist(), both, strict=True):
                held[name] = held[name] + row if name in held else row
        for name, row in held.items():
            for part, piece in enumerate(row.astype(np.int64).reshape(_PARTS, -1)):
                yield pa.record_batch([[name], pa.array([part], pa.int32()), [zlib.compress(piece.tobytes(), 1)]], schema=_COUNTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = np.frombuffer(zlib.decompress(data), np.int64)
                held[name, part] = held[name, part] + piece if (name, part) in held else piece
        for (name, part), piece in held.items():
            yield pa.record_batch([[name], pa.array([part], pa.int32()), [zlib.compress(piece.tobytes(), 1)]], schema=_COUNTS)

    schema = "lang string, part int, counts binary"
    picked = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    if picked.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages in column {lang}")
    rows = picked.mapInArrow(tidied(count), schema).repartition(_PARTS, "lang", "part").mapInArrow(add, schema).collect()
    names = sorted({r.lang for r in rows})
    counts = np.zeros((len(names), BUCKETS), np.int64)
    for r in rows:
        counts[names.index(r.lang)].reshape(_PARTS, -1)[r.part] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return Model(names, counts)


def _mixture(p: np.ndarray, c: np.ndarray, first: np.ndarray, owner: np.ndarray, weights: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from the given weights (zeros stay zero): (weights, log-likelihoods) a text."""
    total = np.add.reduceat(c, first)[:, None]
    for _ in range(rounds):
        share = p * weights[owner]
        share *= (c / share.sum(axis=1))[:, None]
        weights = np.add.reduceat(share, first, axis=0) / total
    return weights, np.add.reduceat(c * np.log((p * weights[owner]).sum(axis=1)), first)


def proportions(table: np.ndarray, raw: np.ndarray, offsets: np.ndarray, penalty: float = 2.0, rounds: int = 10) -> np.ndarray:
    """texts x languages: estimated proportions over the selected languages; zeros for texts without trigrams."""
    n, k = len(offsets) - 1, table.shape[1]
    out = np.zeros((n, k))
    text, gram = trigrams(raw, offsets)
    if not len(text) or not k:
        return out
    key, c = np.unique(text * BUCKETS + gram, return_counts=True)
    owner, gram = key // BUCKETS, key % BUCKETS
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    texts, owner = owner[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    p, c = table[gram], c.astype(float)
    size = np.add.reduceat(c, first)
    weights, _ = _mixture(p, c, first, owner, np.full((len(first), k), 1 / k), rounds)
    rank = np.argsort(np.argsort(-weights, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.where(rank < 1, 1.0, 0.0)
    _, fit = _mixture(p, c, first, owner, best, 0)
    value = fit - penalty * np.log(np.maximum(size, 2))
    growing = np.arange(len(first))
    for s in range(2, k + 1):
        if not len(growing):
            break
        part = np.zeros(len(first), bool)
        part[growing] = True
        if part.all():
            some_p, some_c, some_first, some_owner = p, c, first, owner
        else:
            of = part[owner]
            some_p, some_c, some_owner = p[of], c[of], (np.cumsum(part) - 1)[owner[of]]
            some_first = np.flatnonzero(np.diff(some_owner, prepend=-1))
        w = np.where(rank[growing] < s, np.maximum(weights[growing], 1e-9), 0)
        w, fit = _mixture(some_p, some_c, some_first, some_owner, w / w.sum(axis=1, keepdims=True), rounds)
        now = fit - penalty * s * np.log(np.maximum(size[growing], 2))
        better = now > value[growing]
        growing, w, now = growing[better], w[better], now[better]
        best[growing], value[growing] = w, now
    out[texts] = best
    return out


_OUT = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.list_(pa.float64()))])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", penalty: float = 2.0) -> DataFrame:
    """(id, lang_pred, score, shares in the order of model.languages) of every whole text."""
    names, table = model.languages, docs.sparkSession.sparkContext.broadcast(model.table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            yield pa.record_batch([batch.column("id"), *_labels(batch.column("text"), names, table.value, penalty)], schema=_OUT)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(tidied(run), "id long, lang_pred string, score double, shares array<double>")


def _labels(column: pa.Array, names: list[str], table: np.ndarray, penalty: float) -> tuple[pa.Array, pa.Array, pa.Array]:
    raw, offsets = buffer_of(column)
    shares = proportions(table, raw, offsets, penalty)
    known = has_letter(raw, offsets) & (shares.sum(axis=1) > 0 if len(names) else False)
    top = shares.argmax(axis=1) if len(names) else np.zeros(len(shares), int)
    label = [names[t] if ok else UND for t, ok in zip(top, known, strict=True)]
    score = np.where(known, shares.max(axis=1) if len(names) else 0.0, 0.0)
    return pa.array(label, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(list(shares), pa.list_(pa.float64()))


def keep_known(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5, penalty: float = 2.0) -> DataFrame:
    """The rows, all columns as they are, of which one known language makes up at least `least`."""
    names, table = model.languages, docs.sparkSession.sparkContext.broadcast(model.table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, text):
            label, score, _ = _labels(batch.column(text), names, table.value, penalty)
            yield batch.filter(pa.array((np.array(label.to_pylist(), object) != UND) & (score.to_numpy() >= least)))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder one by three; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(~held_out(id_col) & F.col(id_col).isNotNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(training_rows(docs))
    out = predict(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
