"""Texts longer than the chunks that operators take at once."""

import random

import numpy as np
import pytest

from quarry.llm import bpe, language_id, near_dedup, packing, quality, substring_dedup, suffix_dedup

tokenizers = pytest.importorskip("public_tokenizers")
N = 400_000  # words, about 2.7 MB


@pytest.fixture(scope="module")
def words():
    r = random.Random(7)
    return [f"w{r.randrange(10**6)}" for _ in range(N)]


@pytest.fixture(scope="module")
def docs(spark, words):
    """A long text, one that repeats 60 words of its end, one that differs from it in a word, and a long run of one word."""
    edited = [*words[: N // 2], "edited", *words[N // 2 + 1 :]]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[-100:-40]) + " stop"), (3, " ".join(edited)), (4, "tick " * 300_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_windows(spark, docs, words):
    got = {r.doc_id: r for r in substring_dedup.remove_repeated_windows(spark, docs).collect()}
    assert got[2].n_removed == 60 and got[2].kept_text == "start stop" and got[4].n_removed == 300_000
    assert (got[1].n_removed, got[3].n_removed) == (N - 1, N - 1) and got[1].kept_text == words[N // 2] and got[3].kept_text == "edited"


def test_suffixes(spark, docs, words):
    got = {r.doc_id: r for r in suffix_dedup.remove_earlier_bytes(spark, docs).collect()}
    passage = " ".join(words[-100:-40])
    assert got[1].n_removed == got[4].n_removed == 0
    assert bytes(got[2].kept) == b"startstop" and got[2].n_removed == len(passage) + 2
    assert bytes(got[3].kept) == b"edited"


def test_quality(docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert [got[i].n_words for i in (1, 2, 3, 4)] == [N, 62, N, 300_000]
    assert got[1].kept and got[4].base_failed and got[4].n_repeat_words == 300_000 and got[4].longest_repeat == 299_999


def test_near(spark, docs):
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(spark, docs, shingle=3, percent=85).collect()}[3] == (1, N - 2)


def test_language(spark, docs):
    model = language_id.Model(["a", "b"], np.stack([np.ones(language_id.BUCKETS, np.int64), np.arange(language_id.BUCKETS, dtype=np.int64)]))
    assert all(0 <= r.score <= 1 and r.lang_pred in "ab" for r in language_id.predict(docs, model).collect())


def test_codecs(spark, docs, words):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    got = {r.id: r for r in bpe.encode_decode(docs, tokenizers.path("word_bpe_49k.json")).collect()}
    assert np.frombuffer(got[1].ids, "<u4").tolist() == theirs.encode(" ".join(words), add_special_tokens=False).ids
    byte = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(spark, docs, tokenizers.path("byte_bpe_50k.json")).collect()
    ids = b"".join(bytes(r.ids) for r in sorted((r for r in pieces if r.doc_id == 3), key=lambda r: r.start))
    text = next(r.text for r in docs.collect() if r.doc_id == 3)
    assert np.frombuffer(ids, "<u4").tolist() == [*byte.encode(text, add_special_tokens=False).ids, 0]
    assert sum(r.length for r in pieces) / (1024 * len({r.sequence_id for r in pieces})) > 0.99
