"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched by registers floor(1 - log_b(min h)), the least of
exponentially distributed hashes of its shingles on a logarithmic scale, truncated to 16 bits. Two
sets' registers agree about as often as their Jaccard similarity, and sketches of parts merge by
their maximum.

1. Documents with one and the same shingle set are one node from here on.
2. Bands of registers put nodes into buckets. In a bucket, leaders are compared with the members
   that no earlier leader has claimed; the similarity is estimated jointly by maximum likelihood from
   the registers that are larger, smaller and equal. A leader claims what is close to it, and is
   connected to all that a linked document of a claimed one could be (Jaccard distance obeys the
   triangle inequality), so linked documents end up in one cluster although no bucket is expanded
   into all its pairs. A few bands go first; then, of all bands, only the buckets whose members are
   in several clusters are looked at.
3. In each cluster, pairs are verified on the full sets, the most similar first, unless they are
   already connected.
4. The verified links' connected components are the classes.

Buckets and clusters larger than a bound are dealt in blocks, each row in one. Twice, in clusters,
by different hashes, so that what is linked across blocks meets, too; at the end, where members are
still apart, those outside of the largest part meet every block, the largest part's rows stay in
theirs. So every pair that is apart is looked at, and rows are not copied while they are connected.

Defined results: null and empty texts are linked with nothing and kept; shorter texts than a shingle
are one shingle; a null id keeps its row in its class, but never names one unless the class has no
other id (the class id is then null and the row kept); rows that repeat an id count one by one. A row
is told apart from others by its id and text together, as neither alone is unique. Sets are told apart
by 128 bits, nodes are numbered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import EDGE, components, forest
from .shared import discard, written
from .text import _P, _Q, _R, Words, buffer_of, mix, range_hash, rows_of, tidied

BASE, RATE, TOP = 1.001, 20.0, 65535
BAND_ROWS, BANDS = 7, 36
REGISTERS = BAND_ROWS * BANDS
CLAIM, CONNECT = 0.13, 0.45  # below the threshold by so much: claimed by a leader, connected to it
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 1024
FIRST_BANDS = 3  # bands that are joined first
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _R)
_ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _Q) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, sorted; offsets of each text's set)."""
    words = Words(raw, offsets, lower=True)
    count = np.diff(words.first)
    starts, h = words.windows(k)
    text = words.doc[starts] if len(starts) else starts
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin, end = words.first[:-1][short], words.first[1:][short]
        whole = mix(range_hash(words.code, begin, end, _Q) ^ count[short].astype(np.uint64))
        text, h = np.concatenate([text, short]), np.concatenate([h, whole])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    text, h = text[new], h[new]
    return h, np.searchsorted(text, np.arange(len(offsets)))


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """sets x registers. An empty set's registers are 0."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, REGISTERS), np.uint16)
    if not len(some):
        return out
    first, scale = at[:-1][some], 1 / math.log(BASE)
    v = np.empty_like(h)
    for i in range(REGISTERS):
        np.bitwise_xor(h, _SEEDS[i], out=v)
        np.multiply(v, _ODD[i], out=v)
        least = (np.minimum.reduceat(v, first).astype(float) + 1) / 2.0**64
        exponential = -np.log1p(-np.minimum(least, 1 - 1e-16)) / RATE
        out[some, i] = np.clip(np.floor(1 - np.log(exponential) * scale), 0, TOP)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair of sketches: the maximum of the joint likelihood, given the sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    scale = (BASE - 1) / BASE

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-scale * np.clip(x, 1e-12, 1)) / math.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * j), chance(v - u * j)
        return more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(22):
        x, y = high - golden * (high - low), low + golden * (high - low)
        better = fit(x) > fit(y)
        high, low = np.where(better, y, high), np.where(better, low, x)
    return (low + high) / 2


_SKETCHED = pa.schema([*((c, pa.int64()) for c in ("doc_id", "key", "n_shingles", "set1", "set2")), ("registers", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketch_documents(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(doc_id, key: hash of id and text, n_shingles, set1, set2: hashes of the whole set, registers, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            h, at = shingle_sets(*buffer_of(batch.column("text")), k)
            registers = sketches(h, at)
            wide = registers.astype(np.uint64).reshape(len(registers) * BANDS, BAND_ROWS)
            band = range_hash(wide.reshape(-1) + np.uint64(1), np.arange(len(wide)) * BAND_ROWS, np.arange(1, len(wide) + 1) * BAND_ROWS, _R)
            band = mix(band.reshape(-1, BANDS) ^ _SEEDS[:BANDS]).view(np.int64)
            yield pa.record_batch([batch.column("id"), batch.column("key"), np.diff(at), *whole_sets(h, at), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array(list(band), pa.list_(pa.int64()))], schema=_SKETCHED)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("key", row_key("id", "text"))
    return picked.mapInArrow(tidied(run), "doc_id long, key long, n_shingles long, set1 long, set2 long, registers binary, bands array<long>")


def row_key(id_col: str, text: str) -> Column:
    """What finds a row again, be its id null or repeated; rows equal in id and text share it."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text).cast("string"))


def whole_sets(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each whole set."""
    a, b = (mix(range_hash(mix(h ^ seed), at[:-1], at[1:], base)).view(np.int64) for seed, base in ((_R, _Q), (_Q, _P)))
    return a, b


def in_runs(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts of its groups): whole groups of rows sorted by the key, about `rows` rows at once."""
    held: list[pa.RecordBatch] = []

    def heads(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in key:
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            if sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                starts = heads(table)
                if len(starts) > 1:
                    yield table.slice(0, int(starts[-1])), starts[:-1]
                    held = table.slice(int(starts[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, heads(table)


def in_blocks(members: DataFrame, key: str, counts: DataFrame, block: int, turn: int, apart: DataFrame | None = None) -> DataFrame:
    """Members of each key in blocks; `turn` deals them differently. apart: (key, stay): members whose label is not `stay` go to every block."""
    dealt = members.join(counts.select(key, F.ceil(F.col("n") / block).cast("int").alias("blocks")), key)
    own = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int")
    if apart is None:
        dealt = dealt.withColumn("i", own)
    else:
        dealt = dealt.join(apart, key, "left")
        every = F.when((F.col("blocks") > 1) & (F.col("label") != F.col("stay")), F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = dealt.withColumn("i", F.explode(F.coalesce(every, F.array(own)))).drop("stay")
    return dealt.drop("blocks").repartition(key, "i").sortWithinPartitions(key, "i", "node")


def largest_parts(members: DataFrame, key: str) -> DataFrame:
    """(key, stay: the label that most of its members have)."""
    sizes = members.groupBy(key, "label").agg(F.count("*").alias("n"))
    return sizes.groupBy(key).agg(F.max(F.struct("n", "label")).alias("most")).select(key, F.col("most.label").alias("stay"))


def near_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Edges between the labels of leaders and members of each bucket that may hold links."""
    for table, starts in in_runs(batches, ["bucket", "i"]):
        node = table.column("node").to_numpy()
        size = table.column("n_shingles").to_numpy().astype(float)
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(node), -1)
        label = table.column("label").to_numpy()
        group = np.zeros(len(node), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        waiting = np.arange(len(node))
        edges: list[np.ndarray] = []
        while len(waiting):
            first = np.flatnonzero(np.diff(group[waiting], prepend=-1))
            leader = waiting[np.repeat(first, np.diff(np.append(first, len(waiting))))]
            member = leader != waiting
            a, b = leader[member], waiting[member]
            j = joint_estimate(registers[a], registers[b], size[a], size[b]) if len(a) else np.zeros(0)
            near = (j >= threshold - CONNECT) & (label[a] != label[b])
            edges.append(np.stack([label[a[near]], label[b[near]]], axis=1))
            waiting = b[j < threshold - CLAIM]
        out = np.concatenate(edges)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def verified_links(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between labels that connect all documents of a cluster's block that links connect, each confirmed on full sets."""
    for table, starts in in_runs(batches, ["cluster", "i"], 256):
        a, b = [], []
        for s, e in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
            part = table.slice(int(s), int(e - s))
            h, at = shingle_sets(*buffer_of(part.column("text")), k)
            label = part.column("label").to_numpy()
            own = np.ones(len(label), bool)  # a row that only shares its key with the node's document is passed over
            for name, x in zip(("set1", "set2"), whole_sets(h, at), strict=True):
                own &= x == part.column(name).to_numpy()
            registers = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(len(label), -1)
            for x, y in _cluster_links(np.flatnonzero(own), label, h, at, np.diff(at), registers, percent):
                a.append(label[x])
                b.append(label[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _cluster_links(rows: np.ndarray, label: np.ndarray, h: np.ndarray, at: np.ndarray, size: np.ndarray, registers: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links between rows of different labels that connect what links connect."""
    pairs: list[np.ndarray] = []
    for n, x in enumerate(rows[:-1]):
        y = rows[n + 1 :]
        y = y[(label[y] != label[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
        if len(y):
            equal = (registers[y] == registers[x]).sum(axis=1)
            near = equal >= (percent / 100 - CLAIM - 0.02) * registers.shape[1]
            pairs.append(np.stack([np.full(near.sum(), x), y[near], equal[near]], axis=1))
    if not pairs:
        return []
    pairs = np.concatenate(pairs)
    first = {l: x for x, l in zip(rows.tolist()[::-1], label[rows].tolist()[::-1], strict=True)}
    parent = {x: first[l] for x, l in zip(rows.tolist(), label[rows].tolist(), strict=True)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
        if (p := root(x)) != (q := root(y)):
            s, t = h[at[x] : at[x + 1]], h[at[y] : at[y + 1]]
            place = np.searchsorted(s, t)
            place[place == len(s)] = 0
            both = int((s[place] == t).sum())
            if 100 * both >= percent * (len(s) + len(t) - both):
                parent[p] = q
                out.append((x, y))
    return out


def _joined(nodes: DataFrame, threshold: float, whole: bool) -> DataFrame:
    """The components of the edges between labels that share a bucket of the given bands. whole: members of all blocks of a bucket meet."""
    banded = nodes.select("node", "label", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket", "n")
    crowded = banded.join(buckets.select("bucket"), "bucket")
    apart = largest_parts(banded.join(buckets.filter(F.col("n") > BUCKET_BLOCK).select("bucket"), "bucket"), "bucket") if whole else None
    dealt = in_blocks(crowded.join(nodes.select("node", "n_shingles", "registers"), "node"), "bucket", buckets, BUCKET_BLOCK, 0, apart)
    return components(dealt.mapInArrow(lambda b: forest(near_links(b, threshold)), EDGE))


def _relabelled(members: DataFrame, to: DataFrame) -> DataFrame:
    """members with the labels that `to` (node, label) has for theirs."""
    return members.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def _confirmed(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label) of the nodes that verified links connect. members: cluster, node, set1, set2, registers, text, one row a node."""

    def links(rows: DataFrame, counts: DataFrame, turn: int, apart: DataFrame | None = None) -> DataFrame:
        dealt = in_blocks(rows, "cluster", counts, CLUSTER_BLOCK, turn, apart)
        return components(dealt.mapInArrow(lambda b: forest(verified_links(b, shingle, percent)), EDGE))

    counts = written(members.groupBy("cluster").agg(F.count("*").alias("n")), "counts")
    out = links(members.withColumn("label", F.col("node")), counts, 0)
    large = counts.filter(F.col("n") > CLUSTER_BLOCK)
    if large.isEmpty():
        return out
    rest = members.join(large.select("cluster"), "cluster").withColumn("label", F.col("node"))
    for turn in (1, 2):
        rest = _relabelled(rest, out)
        several = rest.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("cluster")
        rest = rest.join(several, "cluster")
        more = links(rest, large, turn, largest_parts(rest, "cluster") if turn == 2 else None)
        both = _relabelled(out, more)
        out = written(both.unionByName(more.join(out, "node", "left_anti")), "labels")
    return out


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key: see row_key, n_shingles, class) of every row: links are pairs with Jaccard >= percent / 100.

    Rows without shingles are linked with nothing, whatever their class says.
    """
    sketched = written(sketch_documents(docs, id_col, text, shingle), "sketches")
    number = F.monotonically_increasing_id().alias("node")
    one = written(sketched.filter("n_shingles > 0").drop("doc_id").dropDuplicates(["set1", "set2"]).select(number, "*"), "nodes")
    rows = written(sketched.select("doc_id", "key", "n_shingles", "set1", "set2"), "rows")
    discard(sketched)
    first = _joined(one.select("node", "n_shingles", "registers", F.slice("bands", 1, FIRST_BANDS).alias("bands"), F.col("node").alias("label")), percent / 100, False)
    # most groups are whole by now: only buckets that hold several clusters are looked at
    labelled = one.select("node", "n_shingles", "registers", "bands").join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    second = _joined(labelled, percent / 100, True)
    merged = _relabelled(labelled.select("node", "label"), second).withColumnRenamed("label", "cluster")
    crowds = merged.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    clusters = written(merged.join(crowds, "cluster"), "clusters")
    members = clusters.join(one.select("node", "key", "set1", "set2", "registers"), "node")
    texts = docs.select(row_key(id_col, text).alias("key"), F.col(text).cast("string").alias("text"))
    # rows equal in id and text bring a text each: they are one again before they meet in a cluster
    with_text = written(members.join(texts, "key").drop("key").dropDuplicates(["node", "text"]), "members")
    named = one.select("set1", "set2", "node").join(_confirmed(with_text, shingle, percent), "node", "left").select("set1", "set2", F.coalesce("label", "node").alias("class"))
    return rows.join(named, ["set1", "set2"], "left").select("doc_id", "key", "n_shingles", "class")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: links are pairs with Jaccard >= percent / 100."""
    named = classes(spark, docs, id_col, text, shingle, percent)
    ids = named.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    out = named.join(ids, "class", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(spark, docs, shingle=3, percent=85)


ORACLE = r"""
with recursive d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct r, array_to_string(list_slice(w, i, i + 2), ' ') as x from (select r, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)),
sizes as (select r, count(*) as n from shingles group by r),
links as (select a.r as a, b.r as b from shingles a join shingles b on a.x = b.x and a.r <> b.r join sizes m on m.r = a.r join sizes n on n.r = b.r group by a.r, b.r, m.n, n.n having 100 * count(*) >= 85 * (m.n + n.n - count(*))),
reached(r, s) as (select r, r from sizes union select reached.r, links.b from reached join links on links.a = reached.s)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(least_id, d.doc_id) as component_id, coalesce(least_id, d.doc_id) = d.doc_id as kept
from d left join sizes using (r) left join (select reached.r, min(e.doc_id) as least_id from reached join d e on e.r = reached.s group by reached.r) m on m.r = d.r
"""
