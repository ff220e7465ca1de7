"""WARC archives and their two-level capture index.

Writing: a `response` record holds an HTTP head and the payload. Of records with equal payloads of at
least `min_bytes` bytes, the one with the largest id is the response; the others are `revisit`
records that name it and hold the head only. Spark's text writer puts the records out (a record's
end, two line ends, is the line separator), so archives can go to any store that Spark writes.

Index: the archives are streamed once. Captures, keyed by reversed host and path with the record's
id, are range-sorted into shards; each shard is a run of compressed blocks of `block_lines` captures
with a sparse directory of the blocks' first keys. A lookup binary-searches the shard directory, the
block directory and the block, then reads the record's byte range only. Executors read ranges with
pyarrow's file systems (file, hdfs, s3, gs), as Spark has no reader of byte ranges.

Defined results: a null payload is an empty one and is a response; a null id ranks below all others;
rows that share the largest id of their payload are all responses; a null url is an empty one;
repeated rows are records of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import place, written

CRLF = "\r\n"
FILE_BYTES = 32 << 20
BLOCK_LINES = 512
SHARD_LINES = 16 << 10
MAX_SHARDS = 1 << 16  # in the directory that every task has; 16,384 captures in each make 10**9
BROADCAST_DIGESTS = 200_000  # of 48 bytes each


def records(pages: DataFrame, id_col: str, url: str, payload: str, min_bytes: int, date: str) -> DataFrame:
    """(record): the WARC record of each row, without its closing line ends."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(F.col(url).cast("string"), r"\s", "%20"), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload")
    ).withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    large = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    large = written(large, "repeated-payloads")
    few = large.count() <= BROADCAST_DIGESTS  # else payloads move once, to meet their digests
    rows = rows.join(F.broadcast(large) if few else large, "digest", "left")
    revisit = F.coalesce((F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("size").cast("string")), F.lit(CRLF))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    top = F.concat(
        F.lit(f"WARC/1.0{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.lit(date)), line("WARC-Record-ID", name(F.col("id"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("first"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF),
    )
    return rows.select(F.concat(top, block).alias("record"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    size, n = pages.agg(F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)), F.count("*")).first()
    out = records(pages, id_col, url, payload, min_bytes, date)
    per_file = max(1, int(file_bytes / max(1.0, size / max(n, 1) + 500)))
    out.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(folder)


def open_range(uri: str) -> pa.NativeFile:
    scheme, _, path = uri.partition(":")
    system, path = pafs.FileSystem.from_uri(f"{scheme}:///{path.lstrip('/')}" if scheme == "file" else uri)
    return system.open_input_file(path)


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """(fields of a record's head, where its block begins)."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8").split(CRLF)
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x), end + 4


def reversed_key(url: str, record_id: str) -> str:
    """Reversed host, then path and query, then the record's id: com,example,www)/a 7."""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:] + " " + record_id


@dataclass
class Capture:
    key: str
    file: str
    offset: int
    length: int

    def line(self) -> str:
        return f"{self.key}\t{self.offset}\t{self.length}\t{self.file}"

    @classmethod
    def of(cls, line: str) -> Capture:
        key, offset, length, file = line.split("\t", 3)
        return cls(key, file, int(offset), int(length))


def captures(spark: SparkSession, folder: str, window: int = 4 << 20) -> DataFrame:
    """(key, file, offset, length) of every record, by streaming each archive."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                rows, at, held, base = [], 0, b"", 0
                with open_range(path) as file:
                    while at < size:
                        end, more = held.find(b"\r\n\r\n", at - base), window
                        while end < 0:  # the head is not whole in what has been read
                            held, base = file.read_at(min(more, size - at), at), at
                            end, more = held.find(b"\r\n\r\n"), 2 * more
                        fields, begin = parse_head(held[at - base : end + 4])
                        length = begin + int(fields["Content-Length"])
                        rows.append((reversed_key(fields["WARC-Target-URI"], fields["WARC-Record-ID"]), path, at, length))
                        at += length + 4
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length")
    return files.mapInArrow(scan, "key string, file string, offset long, length long")


_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("n", pa.int32()), ("data", pa.binary())])


def build_index(spark: SparkSession, archives: str, folder: str, block_lines: int = BLOCK_LINES, shard_lines: int = SHARD_LINES) -> None:
    from pyspark import TaskContext

    found = captures(spark, archives)
    n = sum(r.n for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives).agg(F.sum("length").alias("n")).collect() if r.n) // 4000
    shards = min(MAX_SHARDS, max(1, -(-n // shard_lines)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, number = TaskContext.get().partitionId(), [], 0

        def pack(lines: list[str]) -> pa.RecordBatch:
            return pa.record_batch([[shard], [number], [lines[0].partition("\t")[0]], [len(lines)], [zlib.compress("\n".join(lines).encode())]], schema=_BLOCKS)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")]
            held += [Capture(*x).line() for x in zip(*columns, strict=True)]
            while len(held) >= block_lines:
                yield pack(held[:block_lines])
                held, number = held[block_lines:], number + 1
        if held:
            yield pack(held)

    ordered = found.repartitionByRange(shards, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    ordered.mapInArrow(blocks, "shard int, block int, first_key string, n int, data binary").write.parquet(folder)


def find_in_block(data: bytes, key: str) -> list[Capture]:
    lines = zlib.decompress(data).decode().split("\n")
    keys = [x.partition("\t")[0] for x in lines]
    return [Capture.of(x) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]


class CaptureIndex:
    """Lookups of single keys from the driver, and of any number of keys by the executors."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.blocks = spark.read.schema("shard int, block int, first_key string, n int, data binary").parquet(folder)
        rows = self.blocks.groupBy("shard").agg(F.min("first_key").alias("first")).orderBy("first", "shard").collect()
        self.shards, self.firsts = [r.shard for r in rows], [r.first for r in rows]  # at most MAX_SHARDS

    def lookup(self, url: str, record_id: str) -> list[Capture]:
        """The captures of one record: shard directory, block directory, block."""
        key, out = reversed_key(url, record_id), []
        for shard in _reach(self.firsts, self.shards, key):
            directory = self.blocks.filter(F.col("shard") == shard).select("block", "first_key").orderBy("block").collect()
            for block in _reach([r.first_key for r in directory], [r.block for r in directory], key):
                data = self.blocks.filter((F.col("shard") == shard) & (F.col("block") == block)).select("data").first()[0]
                out += find_in_block(bytes(data), key)
        return out

    def locate(self, requests: DataFrame) -> DataFrame:
        """(key, file, offset, length) of all captures of the requested keys (column `key`)."""
        directory_ = self.spark.sparkContext.broadcast((self.firsts, self.shards))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, shards = directory_.value
            for batch in batches:
                out = [(s, k) for k in batch.column("key").to_pylist() for s in _reach(firsts, shards, k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], ["shard", "key"])

        names = ["key", "file", "offset", "length"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]

        def search(asked: pa.Table, blocks: pa.Table) -> pa.Table:
            rows = sorted(zip(*(blocks.column(c).to_pylist() for c in ("first_key", "block", "data")), strict=True), key=lambda r: r[1])
            keys = sorted(set(asked.column("key").to_pylist()))
            directory, numbers = [r[0] for r in rows], list(range(len(rows)))
            wanted: dict[int, list[str]] = {}
            for key in keys:
                for i in _reach(directory, numbers, key):
                    wanted.setdefault(i, []).append(key)
            out: list[tuple] = []
            for i, asked_keys in sorted(wanted.items()):
                lines = zlib.decompress(rows[i][2]).decode().split("\n")
                in_block = [x.partition("\t")[0] for x in lines]
                for key in asked_keys:
                    for x in lines[bisect_left(in_block, key) : bisect_right(in_block, key)]:
                        c = Capture.of(x)
                        out.append((c.key, c.file, c.offset, c.length))
            return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        asked = requests.select("key").distinct().mapInArrow(route, "shard int, key string")
        return asked.groupBy("shard").cogroup(self.blocks.groupBy("shard")).applyInArrow(search, "key string, file string, offset long, length long")


def _reach(firsts: list[str], values: list[int], key: str) -> list[int]:
    """The runs that may hold a key: the last that begins before it, and all that begin with it."""
    low = max(bisect_left(firsts, key) - 1, 0)
    return values[low : max(bisect_right(firsts, key), min(low + 1, len(firsts)))]


def read_capture(capture: Capture) -> tuple[dict[str, str], bytes]:
    """(head fields, block) of one record, by a range read."""
    with open_range(capture.file) as file:
        data = file.read_at(capture.length, capture.offset)
    fields, begin = parse_head(data)
    return fields, data[begin:]


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_records(located: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the located byte ranges. A revisit's length and digest are those of the full payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(start, 256)
                for name, offset, length in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if name != path:
                        if file:
                            file.close()
                        path, file = name, open_range(name)
                    rows.append(_row(file.read_at(length, offset), with_payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_READ)], schema=_READ)
        if file:
            file.close()

    ordered = located.repartition("file").sortWithinPartitions("file", "offset") if with_payload else located
    return ordered.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _row(data: bytes, with_payload: bool) -> tuple:
    fields, begin = parse_head(data)
    http = data.index(b"\r\n\r\n", begin) + 4
    payload, kind = data[http:], fields["WARC-Type"]
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    if kind == "revisit":
        head = dict(x.split(": ", 1) for x in data[begin : http - 4].decode().split(CRLF)[1:])
        size, digest = int(head["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return number("WARC-Record-ID"), fields["WARC-Target-URI"], size, digest, kind, number("WARC-Refers-To"), payload if with_payload and kind != "revisit" else None


def request_keys(pages: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("url").to_pylist(), batch.column("id").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([reversed_key(u, f"<urn:page:{i}>") for u, i in pairs], pa.string())], ["key"])

    clean: Column = F.coalesce(F.regexp_replace(F.col(url).cast("string"), r"\s", "%20"), F.lit("")).alias("url")
    return pages.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), clean).mapInArrow(run, "key string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives, index = place(spark, "warc"), place(spark, "cdx")
    write_archives(pages, archives)
    build_index(spark, archives, index)
    located = CaptureIndex(spark, index).locate(request_keys(pages))
    return read_records(located, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as payload from pages),
q as (select page_id, cast(strlen(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest, max(page_id) over (partition by payload) as top from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from q
"""
