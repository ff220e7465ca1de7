"""Texts that differ by a Thue-Morse pattern, on which polynomial hashes modulo a power of two collide for every base."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import bpe, near_dedup, packing, quality, substring_dedup, suffix_dedup, text

tokenizers = pytest.importorskip("public_tokenizers")


def pair(n=2048, seed=1, alphabet="cdefghijklmnopqrstuvwxyz"):
    """Two strings of 2 n letters: every other letter is one of a and b, swapped in the other string."""
    r = random.Random(seed)
    rest = [r.choice(alphabet) for _ in range(n)]
    sign = [bin(i).count("1") % 2 for i in range(n)]
    return tuple("".join(("ab" if s == which else "ba")[0] + c for s, c in zip(sign, rest, strict=True)) for which in (0, 1))


A, B = pair()


def without_triggers():
    """Such a pair in which no phrase ends."""
    for seed in range(2000):
        a, b = pair(2048, seed, "cdef")
        for _ in range(300):
            found = [np.flatnonzero(suffix_dedup.triggers(suffix_dedup._eight(np.frombuffer(x.encode(), np.uint8)), suffix_dedup.PHRASE_BITS)) for x in (a, b)]
            places = sorted({int(p) for f in found for p in f})
            if not places:
                return a, b
            for p in places:
                at = min(p | 1, len(a) - 1)
                c = random.Random(p + seed + _).choice("cdefghijkl")
                a, b = a[:at] + c + a[at + 1 :], b[:at] + c + b[at + 1 :]
    raise AssertionError("no such pair")


def test_range_hash():
    raw = np.frombuffer((A + B).encode(), np.uint8)
    starts, ends = np.array([0, len(A)]), np.array([len(A), 2 * len(A)])
    for base in (text._P, text._Q, text._R):
        assert len(set(text.range_hash(raw, starts, ends, base).tolist())) == 2
        assert len(set(text.range_hash(raw.astype(np.uint64), starts, ends, base).tolist())) == 2


def test_range_hash_against_big_numbers():
    r, p = np.random.default_rng(1), (1 << 61) - 1
    for n in (5, 300, text.SPAN, text.SPAN + 7, 3 * text.SPAN + 11):
        values = r.integers(0, 1 << 64, n, dtype=np.uint64)
        starts = np.append(r.integers(0, n, 20), [0, max(0, n - 5)])
        ends = np.minimum(n, starts + r.integers(0, 50, 22))
        for v, shown in ((values, values.tolist()), (values.astype(np.uint8), (values.astype(np.uint8).astype(int) + 1).tolist())):
            want = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                h = 0
                for x in reversed(shown[s:e]):
                    h = (h * int(text._P) + x) % p
                want.append(h)
            assert text.range_hash(v, starts, ends, text._P).tolist() == want


@pytest.mark.parametrize("name,library", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_codec(name, library):
    from tokenizers import Tokenizer

    codec, theirs = bpe.Codec(tokenizers.path(name), library), Tokenizer.from_file(tokenizers.path(name))
    for part in ([A], [B], [A + " x " + B, B + " " + A]):
        ids, at = codec.encode(part)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(part))] == [theirs.encode(t, add_special_tokens=False).ids for t in part]


def test_codec_tells_words_of_one_hash_apart(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "range_hash", lambda raw, starts, ends, base: (ends - starts).astype(np.uint64))
    path = tokenizers.path("word_bpe_49k.json")
    codec, theirs = bpe.Codec(path), Tokenizer.from_file(path)
    for part in (["one two six ten"], ["dog cat one", None, "été two"], ["ten two"]):
        ids, at = codec.encode(part)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(part))] == [theirs.encode(t or "", add_special_tokens=False).ids for t in part]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, A), (2, B)], "doc_id long, text string").coalesce(1)
    got = packing.pack(spark, docs, path).collect()
    for i, t in ((1, A), (2, B)):
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 0]


def test_lines():
    out = quality.judge(pa.array([1]), *text.buffer_of(pa.array([f"{A}\n{B}\n{A}"])), quality.Limits())
    assert out.column("n_dup_lines").to_pylist() == [1]


def test_lines_of_one_hash(monkeypatch):
    monkeypatch.setattr(quality, "range_hash", lambda raw, starts, ends, base: (ends - starts).astype(np.uint64))
    out = quality.judge(pa.array([1, 2]), *text.buffer_of(pa.array(["ab\ncd\nab\nef\ncd", "xy\nxy"])), quality.Limits())
    assert out.column("n_dup_lines").to_pylist() == [2, 1]


def test_words_in_windows_and_sets(spark):
    words = [f"w{i}" for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join([*words[:20], A, *words[20:40]])), (2, " ".join([*words[:20], B, *words[20:40]]))], "doc_id long, text string").coalesce(1)
    assert {r.n_removed for r in substring_dedup.remove_repeated_windows(spark, docs).collect()} == {0}
    assert {r.component_id for r in near_dedup.near_duplicates(spark, docs, shingle=30, percent=85).collect()} == {1, 2}


def test_phrases(spark):
    a, b = without_triggers()
    assert not {a[i : i + 50] for i in range(len(a) - 49)} & {b[i : i + 50] for i in range(len(b) - 49)}
    out = suffix_dedup.remove_earlier_bytes(spark, spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert {r.n_removed for r in out} == {0}
