"""URL rules decided by Bloom filter cascades, in DataFrame functions only.

A url's candidate keys are all of its host's suffixes joined with all path prefixes as long as some
rule's path. The distinct candidate keys of the corpus are the complete key universe. For each
verdict, level one of a cascade is a Bloom filter of its rules' keys; level two holds the keys of the
universe that level one lets through wrongly, level three the listed keys that level two would
reject, and so on until no level errs. A key's first failing level tells whether it is listed, so
membership is exact for every key of the corpus and no url is joined with anything.

Every level is as large as the list (or the errors that are left) times a logarithm of the
universe's size, and is folded into the plan as a constant: `max_bits` bounds it, and a list whose
filter would be larger is an error.

Defined results: a null url or one without "://" has an empty host and path and fits no rule; a url
that no rule fits gets `default`; of fitting rules the longest (host and path together) wins, of
equally long ones the last in the alphabet; rows may repeat, and other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query's contract, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes at label borders, each with the path's prefixes of the given lengths."""
    labels = F.split(host, r"\.", -1)
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    return F.flatten(F.transform(hosts, lambda h: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(h, p))))


@dataclass(frozen=True)
class Level:
    """A Bloom filter: `bits` bits as words of 64, `hashes` places a key, seeded by `seed`."""

    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    @staticmethod
    def places(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]

    @classmethod
    def of(cls, keys: DataFrame, seed: int, bits: int, hashes: int) -> Level:
        place = F.explode(F.array(*cls.places(F.col("key"), seed, bits, hashes))).alias("place")
        word = keys.select(place).groupBy(F.shiftright("place", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("word"))
        words = [0] * -(-bits // 64)
        for at, value in word.collect():  # at most bits / 64 rows
            words[at] = value
        return cls(seed, bits, hashes, tuple(words))

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded into a constant
        out = F.lit(True)
        for place in self.places(key, self.seed, self.bits, self.hashes):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            out = out & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: odd levels hold listed keys, even ones errors."""
        n = len(self.levels)
        out = F.lit(n % 2 == 1)
        for i in range(n, 0, -1):
            inside = self.levels[i - 1].holds(key)
            out = (inside & out) if i % 2 else (~inside | out)
        return out


MAX_BITS = 1 << 24  # of a filter, some 200,000 listed keys in a corpus of 10**12


def cascade(universe: DataFrame, listed: Column, max_levels: int = 40, max_bits: int = MAX_BITS) -> Cascade:
    """The cascade of the keys that `listed` marks, over a universe of distinct keys in column `key`."""
    levels: list[Level] = []
    inside = universe.filter(listed).select("key")
    outside = universe.filter(~listed).select("key")
    n_in, n_out = universe.agg(F.count_if(listed), F.count_if(~listed)).first()
    while n_in and len(levels) < max_levels:
        odds = max(2.0, n_out / n_in) if not levels else 2.0
        hashes = max(1, math.ceil(math.log2(odds)))
        bits = max(64, math.ceil(n_in * hashes / math.log(2)))
        if bits > max_bits:
            raise ValueError(f"a filter of {n_in} keys needs {bits} bits, more than {max_bits}")
        level = Level.of(inside, len(levels), bits, hashes)
        levels.append(level)
        errors = checkpointed(outside.filter(level.holds(F.col("key"))))
        # the errors must be held by the next level; of the keys held so far, it must not err on `inside`
        inside, outside = errors, inside
        n_in, n_out = errors.count(), n_in
    if n_in:
        raise RuntimeError(f"{n_in} keys are left after {max_levels} levels")
    return Cascade(tuple(levels))


def filter_urls(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    keys = {h + p: verdict for verdict, h, p in rules}
    if len(keys) != len({(h, p) for _, h, p in rules}) or len(keys) != len(rules):
        raise ValueError("two rules have one host and path")
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    asked = parsed.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"), F.lit(None).cast("string").alias("verdict"))
    listed = spark.createDataFrame(list(keys.items()) or [("", "")], "key string, verdict string")
    universe = checkpointed(asked.unionByName(listed).groupBy("key").agg(F.max("verdict").alias("verdict")))
    cascades = {v: cascade(universe, F.coalesce(F.col("verdict") == v, F.lit(False))) for v in sorted({v for v, _, _ in rules})}

    def fitting(verdict: str) -> Column:
        fit = F.filter(F.col("keys"), lambda k: cascades[verdict].holds(k))
        return F.transform(fit, lambda k: F.struct(F.length(k).alias("size"), k.alias("rule"), F.lit(verdict).alias("verdict")))

    found = F.concat(*map(fitting, cascades)) if cascades else F.lit(None).cast("array<struct<size:int,rule:string,verdict:string>>")
    best = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths)).withColumn("best", F.array_max(found))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


ORACLE = """
with p as (
  select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end, '') as rest from pages
), q as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p
), rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (
  select q.page_id, r.h || r.p as rule, r.verdict,
         row_number() over (partition by q.page_id order by length(r.h || r.p) desc) as k
  from q join rules r on (q.host = r.h or ends_with(q.host, '.' || r.h)) and starts_with(q.path, r.p)
)
select q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from q left join m on m.page_id = q.page_id and m.k = 1
"""
