"""op5's shards: of one size, and with many contexts under one anchor."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import suffix_dedup as S

SIDE = S.WINDOW - S.GRAM


def test_shards_have_one_size():
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(4000)) for _ in range(60)]
    chunk = S.Chunk(pa.record_batch([pa.array(range(60), pa.int64()), pa.array(texts)], names=["id", "text"]), S.WINDOW)
    _, gram = chunk.anchors(chunk.valid())
    n = np.bincount(((gram >> np.uint64(32)) * np.uint64(64) >> np.uint64(32)).astype(np.int64), minlength=64)
    assert n.sum() > 10_000 and n.max() < 2 * n.mean()


def held_by_smaller_ids(entry):
    """By brute force: of each context, a bit for each window that a smaller id holds."""
    found = []
    for x in entry:
        text, left, right = x["text"].tobytes(), int(x["left"]), int(x["right"])
        found.append({b: text[SIDE - b : SIDE - b + S.WINDOW] for b in range(SIDE + 1) if b <= left and SIDE - b <= right})
    least: dict[bytes, int] = {}
    for x, windows in zip(entry, found, strict=True):
        for w in windows.values():
            least[w] = min(least.get(w, x["id"]), x["id"])
    return [sum(1 << b for b, w in windows.items() if least[w] < x["id"]) for x, windows in zip(entry, found, strict=True)]


@pytest.mark.parametrize("gram", [b"passage that many hold. ", b" the the the the the the"])
def test_one_anchor_with_many_contexts(monkeypatch, gram):
    r = random.Random(5)
    before = [bytes(r.choice(b"ab ") for _ in range(SIDE)) for _ in range(3)]
    after = [bytes(r.choice(b"ab ") for _ in range(SIDE)) for _ in range(3)]
    entry = np.zeros(1500, S.context_type(S.WINDOW))
    for i in range(len(entry)):
        a, b, left, right = bytearray(r.choice(before)), bytearray(r.choice(after)), SIDE, SIDE
        if i % 3 == 0:
            a[r.randrange(SIDE)] = r.randrange(97, 123)
            b[r.randrange(SIDE)] = r.randrange(97, 123)
        if i % 5 == 0:  # a document that begins or ends close to the anchor
            left, right = r.choice([(r.randrange(SIDE), SIDE), (SIDE, r.randrange(SIDE))])
        text = np.frombuffer(bytes(a) + gram + bytes(b), np.uint8).copy()
        text[: SIDE - left], text[SIDE + S.GRAM + right :] = 0, 0
        entry[i] = r.randrange(200), left, right, text
    sizes = []

    def order(symbols, *rest, inner=S.prefix_free_order):
        sizes.append(len(symbols))
        return inner(symbols, *rest)

    monkeypatch.setattr(S, "prefix_free_order", order)
    monkeypatch.setattr(S, "SORTED_AT_ONCE", 50)
    chosen, answer = S.earlier_windows(S.WINDOW)(np.full(len(entry), 7, np.uint64), np.arange(len(entry), dtype=np.uint64), entry)
    mask = np.zeros(len(entry), np.int64)
    mask[chosen] = answer
    assert mask.tolist() == held_by_smaller_ids(entry) and 0 < np.count_nonzero(mask) < len(entry)
    assert max(sizes) <= 51 * (2 * S.WINDOW - S.GRAM)  # at most 50 contexts and what stays from those before


def test_a_task_of_the_stage_holds_one_worker(spark):
    """Python workers live on, so each that a task holds beside another one counts in an executor's memory from then on."""
    docs = spark.createDataFrame([(1, "é" * 40, "x"), (2, "a" + "é" * 40 + "b", "y"), (3, None, "z")], "doc_id long, text string, kept string")
    out = corpus_pipeline.cut_repeated_passages(spark, docs, "")
    assert [tuple(r) for r in out.collect()] in ([(1, "é" * 40, "x"), (2, "ab", "y")], [(2, "ab", "y"), (1, "é" * 40, "x")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan
