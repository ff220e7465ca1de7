"""The stages one after another on the smallest tables, each against what it may and must do."""

import collections
import random
import re
import struct
import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stages(spark):
    from quarry.llm.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"input": {r.doc_id: r.text for r in docs.collect()}}
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(kept[name])
    assert len(kept["language_id"]) >= 0.95 * len(kept["input"])
    before, after = kept["quality_rules"], kept["near_dedup"]
    sets = {i: shingles(t) for i, t in before.items()}
    links = {(i, j) for i in before for j in before if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    parent = {i: i for i in before}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    assert set(after) == {i for i in before if root(i) == i}
    cut = kept["suffix_dedup"]
    first = {}
    for i in sorted(after):
        b = after[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        want = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert cut.get(i, "") == want
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokens = collections.Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert set(tokens) == set(cut) and all(p.doc_tokens == tokens[p.doc_id] for p in pieces)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", source, len(t) if t is not None else None) for i, t, source in rows], SCHEMA).repartition(3)


def near_copy(text, seed):
    w = text.split(" ")
    w[len(w) // 2] = f"edit{seed}"
    return " ".join(w)


def test_near_dedup_of_rows_without_ids(spark):
    a, b, c, d = (" ".join(words(200, seed)) for seed in range(4))
    rows = [(5, a, "least"), (9, near_copy(a, 1), "copy"), (None, near_copy(a, 2), "null copy of a named one"), (None, b, "b"), (None, near_copy(b, 3), "b"), (None, b, "b"), (None, c, "c"), (7, d, "d"), (None, "", "empty"), (None, None, "null")]
    out = pipeline.keep_one_of_each_group(spark, table(spark, rows), SF).collect()
    assert sorted(r.source for r in out) == ["b", "c", "d", "empty", "least", "null"]


def test_near_dedup_of_repeated_ids(spark):
    a, b, c = (" ".join(words(200, seed)) for seed in range(20, 23))
    rows = [(3, a, "a"), (3, b, "b"), (3, near_copy(b, 1), "b"), (4, c, "z"), (4, c, "y"), (4, c, "z"), (8, near_copy(a, 2), "copy"), (8, c, "copy")]
    for some in (rows, rows[::-1]):
        out = pipeline.keep_one_of_each_group(spark, table(spark, some), SF).collect()
        assert sorted((r.doc_id, r.source) for r in out) == [(3, "a"), (3, "b"), (4, "y")]


def test_cut_passages_of_rows_without_ids(spark):
    a, b = " ".join(words(60, 10)), " ".join(words(60, 11))
    rows = [(1, a, "first"), (2, f"start {a}", "cut"), (3, b, "twice"), (3, f"{b} more", "twice"), (3, b, "twice"), *((None, f"{a} {i}", f"null {i}") for i in range(6)), (None, a, "null again"), (None, a, "null again"), (None, None, "gone")]
    out = pipeline.cut_repeated_passages(spark, table(spark, rows), SF)
    assert out.columns == table(spark, rows).columns
    want = [(i, "start " if source == "cut" else t, source) for i, t, source in rows if source != "gone"]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.source)) for r in out.collect())
    assert all(r.n_chars == len(r.text) and r.lang == "en" for r in out.collect())


def repeated_words(w, size):
    count = collections.Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    inside = [False] * len(w)
    for i in range(len(w) - size + 1):
        if count[tuple(w[i : i + size])] > 1:
            inside[i : i + size] = [True] * size
    return sum(inside)


def good(text):
    """The quality rules, by windows: words in repeats of 4 words or more, and no repeat of over 50."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return len(w) >= 20 and 100 * repeated_words(w, 8) <= 30 * len(w) and repeated_words(w, 4) <= 0.5 * len(w) and not repeated_words(w, 51)


def one_of_each_group(rows):
    sets, parent = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in rows:
        for j in rows:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: t for i, t in rows.items() if root(i) == i}


def without_earlier_passages(rows):
    first, out = {}, {}
    for i in sorted(rows):
        b = rows[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return {i: t for i, t in out.items() if t}


def test_run_against_brute_force(spark):
    """run() on whole tables; the languages' model is the operator's own, all else is counted anew."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.llm import language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(language_id.training_rows(docs))
    rows = {r.doc_id: r.text for r in docs.collect()}
    said = {r.id: r for r in language_id.predict(docs, model).collect()}
    rows = {i: t for i, t in rows.items() if said[i].lang_pred != "und" and said[i].score >= 0.5}
    rows = without_earlier_passages(one_of_each_group({i: t for i, t in rows.items() if good(t)}))
    tokens = {i: [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids, 0] for i, t in rows.items()}
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    places, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in out.collect():
        piece = tokens[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(tokens[r.doc_id]) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(tokens)
    for i, held in pieces.items():
        assert [s for s, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) == len(tokens[i])
    for held in places.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024
    assert sum(map(len, tokens.values())) >= 0.98 * 1024 * len(places)


CLASH = SCHEMA + ", id long, node string, block int, label string, `class` string, chosen_id long, key string, length int, part int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", source, len(t) if t is not None else None, 1, "n", 2, "l", "c", 3, "k", 4, 5) for i, t, source in rows], CLASH).repartition(3)


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns, one stage after another."""
    a, b = " ".join(words(300, 30)), " ".join(words(300, 31))
    long = " ".join(words(150_000, 32))
    rows = [(1, a, "a"), (None, b, "b"), (2, None, "null"), (3, "", "empty"), (4, long, "long"), (4, long, "long"), (None, None, "nothing"), (5, f"{near_copy(a, 1)}", "near"), (6, " ".join(a.split(" ")[100:180]) + " " + " ".join(words(200, 33)), "passage")]
    docs = clashing(spark, rows)
    out = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns, name
    left = sorted((r.source, r.doc_id, len(r.text)) for r in out.collect())
    assert {x[0] for x in left} <= {"a", "b", "long", "passage"}
    for stage in (pipeline.keep_one_of_each_group, pipeline.cut_repeated_passages, pipeline.keep_good_quality):
        got = {r.source: len(r.text or "") for r in stage(spark, docs, SF).collect()}
        assert got["long"] == len(long) and got["b"] == len(b)
        assert "passage" in got and (stage is not pipeline.cut_repeated_passages or got["passage"] < len(rows[-1][1]) - 400)
    assert sum(r.length for r in pipeline.pack_sequences(spark, docs, SF).collect()) > 150_000


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
