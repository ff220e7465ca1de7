"""The operators of quarry.llm against brute force, on small fixtures with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, language_id, near_dedup, packing, quality, substring_dedup, suffix, suffix_dedup, topk, url_filter, warc
from quarry.llm.text import Words, buffer_of, rows_of

tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def prose(n, seed, words=40):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "été", "ñandú", "Über", "x", "y1", "zeta,"]) + str(r.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(60, 1)
    texts = [None, "", "  \n\t ", "one", prose(300, 2), prose(300, 2), shared + " " + prose(80, 3), prose(30, 4) + "\n" + shared, prose(200, 5).replace(" ", "  "), "word " * 400, prose(6000, 6), "né " * 30, prose(300, 2) + " end", "a\x00b " * 20, "x" * 3000]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, (7, prose(30, 4) + "\n" + shared), (None, shared), (None, None), (900, prose(300, 2))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    data = [(i, t, "en" if (i or 0) % 2 else "fr", 3, 4, "k", b"z") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, id int, block int, node string, ids binary").repartition(3)


def empty(docs):
    return docs.filter("1 = 0")


def as_words(text):
    return WORD.findall(text or "")


# 2


def test_substring_dedup(spark, docs, rows):
    window = 12
    got = substring_dedup.remove_repeated_windows(spark, docs, window=window, block_bytes=9000).collect()
    count = collections.Counter(tuple(w[i : i + window]) for _, t in rows for w in [as_words(t)] for i in range(len(w) - window + 1))
    want = []
    for i, t in rows:
        w = as_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in got)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_a_full_sketch_loses_nothing(spark, docs):
    full = {(r.doc_id, r.kept_text) for r in substring_dedup.remove_repeated_windows(spark, docs, window=12, cells=16).collect()}
    assert full == {(r.doc_id, r.kept_text) for r in substring_dedup.remove_repeated_windows(spark, docs, window=12).collect()}


# 5


@pytest.mark.parametrize("block_bytes", [7000, 1 << 20])
def test_suffix_dedup(spark, docs, rows, block_bytes):
    got = suffix_dedup.remove_earlier_bytes(spark, docs, block_bytes=block_bytes).collect()
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            if i is not None:
                first[b[j : j + 50]] = min(i, first.get(b[j : j + 50], i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if i is not None and first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        want.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g), spans))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    assert sorted(want, key=key) == sorted([(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), [tuple(s) for s in r.spans]) for r in got], key=key)


def test_prefix_free_order():
    r = random.Random(5)
    for t in range(200):
        texts = [bytes(r.choice(b"ab" if t % 2 else b"abcd") for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 6))]
        texts += texts[: 2 * (t % 3 == 0)]
        symbols = np.frombuffer(b"".join(texts), np.uint8)
        end = np.repeat(np.cumsum([len(x) for x in texts]), [len(x) for x in texts])
        trigger = np.zeros(len(symbols), bool)
        for i in range(len(symbols) - 2):
            trigger[i] = (int(symbols[i]) * 7 + int(symbols[i + 1]) * 5 + int(symbols[i + 2]) * 3) % 4 == 0
        order = suffix.prefix_free_order(symbols, end, trigger, 3)
        suffixes = [bytes(symbols[i : end[i]]) for i in range(len(symbols))]
        assert sorted(order) == list(range(len(symbols))) and [suffixes[i] for i in order] == sorted(suffixes)


# 6


def brute_quality(text):
    text = text or ""
    w = as_words(text)
    n = len(w)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    gone = [False] * n
    for i in range(n - 7):
        if count[tuple(w[i : i + 8])] > 1:
            gone[i : i + 8] = [True] * 8
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, sum(gone), n < 20 or 100 * sum(gone) > 30 * n


def test_quality(docs, rows):
    more = ["x\ny\nx\n\nx", "# a | b <c>\n" * 3, prose(60, 9) + " " + prose(60, 9)]
    got = quality.quality(docs.unionByName(docs.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True)).collect()
    want = [(i, *brute_quality(t)) for i, t in [*rows, *((1000 + i, t) for i, t in enumerate(more))]]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    for r, (_, t) in ((r, x) for r in got for x in [*rows, *((1000 + i, t) for i, t in enumerate(more))] if r.doc_id == x[0] and r.n_words == len(as_words(x[1])) and r.word_chars == sum(map(len, as_words(x[1])))):
        w = as_words(t)
        count = collections.Counter(tuple(w[i : i + 4]) for i in range(len(w) - 3))
        inside = [any(count[tuple(w[j : j + 4])] > 1 for j in range(max(0, i - 3), min(i, len(w) - 4) + 1)) for i in range(len(w))]
        assert r.n_covered_words == sum(inside)
        assert r.kept == (not r.base_failed and sum(inside) <= 0.5 * len(w) and r.longest_repeat <= 50)
    assert {r.longest_repeat for r in got if r.doc_id == 1002} == {60}


def test_quality_limits_beyond_the_base_rules(spark):
    def plain(n, seed):
        return prose(n, seed, 10**6)

    passage = plain(51, 60)
    texts = {
        "stutter": " ".join(f"w{i} " * 7 for i in range(12)),  # repeats of 6 words: no 8-word window comes twice
        "phrases": " ".join(f"a b c d e {x}" for x in plain(40, 61).split()),
        "passage": f"{plain(300, 62)} {passage} {plain(300, 63)} {passage}",
        "shorter passage": f"{plain(300, 62)} {passage.rsplit(' ', 1)[0]} {plain(300, 63)} {passage.rsplit(' ', 1)[0]} {plain(1, 64)}",
        "half": "a b c d " + plain(8, 65) + " a b c d " + plain(8, 66),
        "long": plain(20000, 67),
        "clean": plain(100, 68),
    }
    docs = spark.createDataFrame([(i, name, t) for i, (name, t) in enumerate(texts.items())], "doc_id long, source string, text string")
    got = {list(texts)[r.doc_id]: r for r in quality.quality(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {name for name, r in got.items() if not r.kept} == {"stutter", "phrases", "passage"}
    assert got["stutter"].n_covered_words == 84 and got["phrases"].n_covered_words == 200 and got["passage"].longest_repeat == 51
    assert {r.source for r in quality.keep_good(docs).collect()} == set(texts) - {"stutter", "phrases", "passage"}


def test_longest_repeats():
    r = random.Random(2)
    for _ in range(100):
        texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(3)]
        words = Words(*buffer_of(pa.array(texts)))
        got = quality.longest_repeats(words).tolist()
        want = []
        for t in texts:
            w = t.split()
            want += [max([next(k for k in range(len(w) + 1) if max(i, j) + k == len(w) or w[i + k] != w[j + k]) for j in range(len(w)) if j != i], default=0) for i in range(len(w))]
        assert got == want


# 7 and 1

TEXTS = ["", " ", "Don't 's 'S'RE ΣΣAΣ", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "á é́ ẞ İ ½ Ⅷ 漢字かな مرحبا 😀👩‍👩‍👧", "a" * 3000, "1234 a1b2 !!! ..'s", "\x00\x01    x", "ﬁ Å", "fo'o'sbar ,'s \n's\t\t'll", "हिन्दी ไทย", "tail  \n", " lead", "'", "a\u00a0 b\u2003c", prose(500, 8)]


@pytest.mark.parametrize("name,library", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", False), ("byte_bpe_50k.json", True)])
def test_codec(name, library):
    from tokenizers import Tokenizer

    codec, theirs = bpe.Codec(tokenizers.path(name), library), Tokenizer.from_file(tokenizers.path(name))
    codec.words.limit = 4000  # emptied often
    r = random.Random(1)
    texts = [*TEXTS, None, *("".join(r.choice("ab 'stmdrevl\n.1é") for _ in range(40)) for _ in range(300))]
    for part in (texts, texts[5:9], [None]):
        ids, at = codec.encode(part)
        back = codec.decode(ids, at)
        for i, t in enumerate(part):
            want = theirs.encode(t or "", add_special_tokens=False).ids
            assert ids[at[i] : at[i + 1]].tolist() == want, t
            assert back[i] == theirs.decode(want, skip_special_tokens=False)


def test_encode_decode(docs, rows):
    got = bpe.encode_decode(docs, tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == len(rows) and {len(r.ids) for r in got if r.id == 0} == {0}
    assert bpe.encode_decode(empty(docs), tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("size", [16, 1024])
def test_packing(spark, docs, rows, size):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(spark, docs, tokenizers.path("byte_bpe_50k.json"), size=size).collect()
    want = collections.Counter(tuple(theirs.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length <= 4 * size
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in want.items())
    single = {i: t for i, t in rows if sum(j == i for j, _ in rows) == 1}
    for i, t in single.items():
        ids = b"".join(bytes(r.ids) for r in sorted(by_doc[i], key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(t or "", add_special_tokens=False).ids + [0]
    for parts in by_sequence.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= size
    assert packing.pack(spark, empty(docs), tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_shortest_pack_first_places_everything():
    r = random.Random(3)
    for _ in range(50):
        histogram = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 40))}
        packs = packing.shortest_pack_first(histogram, 64)
        placed = collections.Counter()
        for n, lengths in packs:
            assert sum(lengths) <= 64 and n > 0
            for x in lengths:
                placed[x] += n
        assert dict(placed) == histogram
    many = {n: r.randint(1, 300) for n in range(1, 1025)}
    packs = packing.shortest_pack_first(many, 1024)
    assert sum(n * k for n, k in many.items()) >= 0.99 * 1024 * sum(n for n, _ in packs)


# 8


def brute_classes(rows, k, percent):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = as_words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return [(d, len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_dedup(spark, docs, rows, k, percent):
    r = random.Random(4)
    base = prose(200, 50, 4000).split()
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 8):
            w[r.randrange(200)] = f"edit{r.randrange(10**6)}"
        near.append((2000 + i if i % 9 else None, " ".join(w)))
    near += near[5:7]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = near_dedup.near_duplicates(spark, both, shingle=k, percent=percent).collect()
    assert sorted(map(str, brute_classes([*rows, *near], k, percent))) == sorted(str((x.doc_id, x.n_shingles, x.component_id)) for x in got)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 5)
    base = prose(300, 51, 4000)
    near = [(i, base + f" tail{i}") for i in range(40)]
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0} and len(got) == 40


def test_many_near_copies_in_blocks(spark, monkeypatch):
    """Several large families, dealt in many blocks: the classes are those of all links, near ones that are no links included."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 50)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 50)
    r = random.Random(12)
    rows = []
    for family in range(3):
        base = prose(120, 70 + family, 10**5).split()
        for _ in range(200):
            w = list(base)
            for _ in range(r.choice([1, 2, 3, 4, 6, 9])):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    want = {d: c for d, _, c in brute_classes(rows, 3, 85)}
    assert {x.doc_id: x.component_id for x in got} == want
    assert 10 < len(set(want.values())) < 500


def test_components():
    """Spanning stars connect what the edges connect; the rounds of components() too, on a long path."""
    from quarry.llm.graph import spanning_stars

    r = np.random.default_rng(8)
    for n, m in ((10, 4), (200, 150), (2000, 1500), (500, 3000)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        root = np.arange(n)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = root[x], root[y]
            root[root == max(p, q)] = min(p, q)
        low, node = spanning_stars(a, b)
        want = {i: root[i] for i in range(n) if root[i] != i}
        assert dict(zip(node.tolist(), low.tolist(), strict=True)) == want


def test_components_of_a_path(spark):
    from quarry.llm.graph import components

    order = list(range(300))
    random.Random(3).shuffle(order)
    edges = [*zip(order, order[1:], strict=False), (1000, 1001), (1001, 1002), (1003, 1003)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(300)}) == 1 and got[1000] == got[1001] == got[1002] != got[0]


def test_near_dedup_of_nothing(spark, docs):
    assert near_dedup.near_duplicates(spark, empty(docs)).count() == 0


def test_joint_estimate():
    r = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.85, 0.95):
        both = r.integers(0, 1 << 63, int(2000 * j), dtype=np.uint64)
        rest = r.integers(0, 1 << 63, 2000 - len(both), dtype=np.uint64)
        a, b = np.unique(np.concatenate([both, rest[::2]])), np.unique(np.concatenate([both, rest[1::2]]))
        s = near_dedup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert abs(near_dedup.joint_estimate(s[:1], s[1:], np.array([len(a)]), np.array([len(b)]))[0] - j) < 0.1
        union = near_dedup.sketches(np.union1d(a, b), np.array([0, len(np.union1d(a, b))]))
        assert (near_dedup.merge(s[0], s[1]) == union[0]).all()


# 4


def test_language_id(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language_id.query(spark, SF).collect()}
    held = [r for r in table.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {r.doc_id for r in held}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    model = language_id.learn(language_id.training_rows(table))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "漢字"), (None, "the of and")], "doc_id long, text string")
    labels = {r.id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    assert [labels[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and labels[4][0] in model.languages and labels[None][0] in model.languages
    nothing = language_id.learn(empty(docs))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_mixture_proportions():
    a, b = "the of and to in that " * 30, "der die und das ist nicht " * 30
    raw, at = buffer_of(pa.array([a, b, a + b, a * 3 + b]))
    model = language_id.Model(["de", "en"], np.zeros((2, language_id.BUCKETS), np.int64))
    for row, text in ((0, b), (1, a)):
        _, gram = language_id.trigrams(*buffer_of(pa.array([text])))
        model.counts[row] = np.bincount(gram, minlength=language_id.BUCKETS)
    shares = language_id.proportions(model.table(), raw, at)
    assert shares[0][1] > 0.99 and shares[1][0] > 0.99 and 0.4 < shares[2][0] < 0.7 and 0.65 < shares[3][1] < 0.8
    assert np.allclose(shares.sum(axis=1), 1)


# 9


def test_top_k(spark):
    r = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in r.normal(size=6).astype(np.float32)]) for i in range(300)]
    data += [(300, None), (350, [float("nan")] * 6), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (450, [0.5, 0.5]), (451, [0.5, 0.25])] + [(500 + i, data[7][1]) for i in range(20)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [tuple(x) for x in topk.top_k(spark, frame, "id % 50 = 0", shard_rows=20).collect()]
    good = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in [i for i in good if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(got) == sorted(want)


def test_tree_bounds_hold():
    r = np.random.default_rng(4)
    rows = np.floor(r.normal(size=(500, 5)) * 100)
    tree = topk.Tree.build(np.arange(500), rows, 16)
    q = np.floor(r.normal(size=(9, 5)) * 100)
    bounds = tree.bounds(q)
    for node, (a, b) in enumerate(zip(tree.first, tree.last, strict=True)):
        assert (bounds[:, node] >= (q @ tree.rows[a:b].T).max(axis=1)).all()


# 10


def test_url_filter(spark):
    urls = [None, "", "nope", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.b.example.com/en/", "http://example.com", "https://x.net/es/1", "https://net/fr/", "https://xnet/fr/", "http://com/", "http://icom/a", "ftp://a.net?x=/es/", "://h.com/p", "http://x.com/a://b/en/", "http://ÄB.com/é"]
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls)], "page_id long, url string, key int")
    got = {r.page_id: tuple(r) for r in url_filter.filter_urls(spark, frame).collect()}

    def judge(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert got == {i: (i, *judge(u)) for i, u in enumerate(urls + urls)}
    assert url_filter.filter_urls(spark, frame.filter("page_id < 0")).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 37 == 0).alias("listed")).cache()
    c = url_filter.cascade(universe, F.col("listed"))
    assert len(c.levels) >= 1
    wrong = universe.filter(c.holds(F.col("key")) != F.col("listed")).count()
    assert wrong == 0


# 3


def test_warc(spark, tmp_path):
    big, big2 = "é" * 600, "z\r\n\r\nWARC/1.0\r\n" * 100
    data = [(1, "http://a.com/x?q=1", big), (5, "http://b.org/", big), (3, None, big), (None, "http://c.com/ \r\nInjected: 1", big), (7, "http://a.com/x?q=1", None), (8, "u", ""), (9, "http://d.net", "short"), (10, "http://d.net", "short"), (11, "http://e.net/" + "p" * 70000, big2), (12, "x", big2), (12, "x", big2)]
    frame = spark.createDataFrame([(*d, "extra") for d in data], "page_id long, url string, html string, record string").repartition(3)
    archives, index = str(tmp_path / "warc"), str(tmp_path / "cdx")
    warc.write_archives(frame, f"file://{archives}", file_bytes=4000)
    warc.build_index(spark, f"file://{archives}", index, block_lines=2, shard_lines=1)
    cdx = warc.CaptureIndex(spark, index)
    got = warc.read_records(cdx.locate(warc.request_keys(frame))).collect()
    want = []
    for i, _, html in data:
        b = (html or "").encode()
        top = max((j for j, _, h in data if h == html and j is not None), default=None)
        revisit = len(b) >= 1000 and i != top
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None, None if revisit else b))
    key = lambda x: str(x[:3])
    assert sorted(want, key=key) == sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], key=key)
    (capture,) = cdx.lookup("http://b.org/", "<urn:page:5>")
    fields, block = warc.read_capture(capture)
    assert fields["WARC-Type"] == "response" and block.endswith(big.encode())
    assert cdx.lookup("http://b.org/", "<urn:page:6>") == []


# all


def test_rows_of_covers_everything():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 100, "", "c" * 5])})
    parts = list(rows_of(iter([batch, batch.slice(0, 0), batch.slice(2)]), "text", 20))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist() + batch.column(0).to_pylist()[2:]


def test_empty_tables_of_others(spark, docs, tmp_path):
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(spark, nothing, "id % 50 = 0").count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/warc")
    warc.build_index(spark, f"file://{tmp_path}/warc", f"{tmp_path}/cdx")
    assert warc.read_records(warc.CaptureIndex(spark, f"{tmp_path}/cdx").locate(warc.request_keys(pages))).count() == 0
    model = language_id.learn(docs)
    assert language_id.predict(empty(docs), model).count() == 0 and language_id.keep_known(empty(docs), model).count() == 0


def test_top_k_beyond_64_bits(spark):
    data = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0]), (50, [2.0, 3.0]), (100, [1e18, -1e18])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk.top_k(spark, frame, "id % 50 = 0").collect()]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in data}
    want, most = [], 2**63 - 1
    for q in (0, 50, 100):
        scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(got) == sorted(want)


def test_splits_deal_evenly():
    rows = np.random.default_rng(5).normal(size=(4000, 6))
    splits = topk.Splits.of(rows[:1000], 16)
    sizes = np.bincount(splits.shard_of(rows), minlength=16)
    assert len(sizes) == 16 and sizes.min() > 120 and sizes.max() < 420
    same = np.ones((500, 3))
    assert topk.Splits.of(same, 8).shard_of(same).max() == 0
    mostly = np.concatenate([same, rows[:100, :3]])
    assert set(topk.Splits.of(mostly, 8).shard_of(same)) != set(range(8)) and len(set(topk.Splits.of(mostly, 8).shard_of(mostly))) > 2


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(language_id.learn(docs, max_languages=5).languages) == 5
    with pytest.raises(ValueError):
        language_id.learn(docs, max_languages=4)


def brute_mixture(counts, table, weights, rounds):
    for _ in range(rounds):
        new = dict.fromkeys(weights, 0.0)
        for gram, c in counts.items():
            total = sum(table[gram][k] * w for k, w in weights.items())
            for k, w in weights.items():
                new[k] += c * table[gram][k] * w / total
        weights = {k: x / sum(counts.values()) for k, x in new.items()}
    fit = sum(c * np.log(sum(table[gram][k] * w for k, w in weights.items())) for gram, c in counts.items())
    return weights, fit


def test_proportions_against_a_loop():
    """Expectation-maximisation and the selection of languages, text by text in plain Python."""
    r = random.Random(9)
    languages = {k: [f"{k}{r.choice('aeiou')}{r.choice('lmnrst')}" for _ in range(30)] for k in ("b", "f", "g", "k")}
    model = language_id.Model(list(languages), np.zeros((4, language_id.BUCKETS), np.int64))
    for row, vocabulary in enumerate(languages.values()):
        _, gram = language_id.trigrams(*buffer_of(pa.array([" ".join(r.choice(vocabulary) for _ in range(400))])))
        model.counts[row] = np.bincount(gram, minlength=language_id.BUCKETS)
    texts = [" ".join(r.choice(languages[r.choice(some)]) for _ in range(n)) for n in (3, 20, 80) for some in ("b", "bf", "fgk", "bfgk", "bbbf")]
    raw, offsets = buffer_of(pa.array(texts))
    table = model.table()
    got = language_id.proportions(table, raw, offsets)
    for t, shares in zip(texts, got, strict=True):
        _, gram = language_id.trigrams(*buffer_of(pa.array([t])))
        counts = collections.Counter(gram.tolist())
        size = sum(counts.values())
        weights, _ = brute_mixture(counts, table, dict.fromkeys(range(4), 0.25), 10)
        order = sorted(range(4), key=lambda k: -weights[k])
        best, value = brute_mixture(counts, table, {order[0]: 1.0}, 0)
        value -= 2.0 * np.log(size)
        for s in range(2, 5):
            start = {k: max(weights[k], 1e-9) for k in order[:s]}
            now, fit = brute_mixture(counts, table, {k: x / sum(start.values()) for k, x in start.items()}, 10)
            if fit - 2.0 * s * np.log(size) <= value:
                break
            best, value = now, fit - 2.0 * s * np.log(size)
        assert np.allclose(shares, [best.get(k, 0) for k in range(4)], atol=1e-9), t


@pytest.mark.parametrize("run", [lambda s, d: substring_dedup.remove_repeated_windows(s, d), lambda s, d: suffix_dedup.remove_earlier_bytes(s, d), lambda s, d: quality.quality(d), lambda s, d: quality.keep_good(d)])
def test_empty_tables(spark, docs, run):
    assert run(spark, empty(docs)).count() == 0
