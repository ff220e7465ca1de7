"""One scan: a folder of sources in, the next snapshots of all relations out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.operators import state as K
from quarry.operators.queries import distinct_totals, file_metrics
from quarry.plans.shared import temporary, written
from quarry.sources import files as S
from quarry.sources.languages import LANGUAGES, Language


@dataclass
class Options:
    only: list[str] | None = None
    max_size: int = S.MAX_SIZE
    skip_dirs: list[str] | None = None
    incremental: bool | None = None  # None: if a session is there already
    languages: tuple[Language, ...] = LANGUAGES
    keep_sessions: int = 3
    use_parse_cache: bool = True
    keep_snapshots: int = 2


@dataclass
class Result:
    """files: listed, parsed, taken from the parse cache, gone; functions and variables: distinct ones held now, and by what became of them."""

    session: int
    listed: int
    parsed: int
    cached: int
    gone: int
    functions: int
    variables: int
    function_changes: dict[str, int]
    variable_changes: dict[str, int]
    errors: int
    milliseconds: int


TABLES = ["functions", "function_deps", "global_vars", "file_metrics", "file_cache", "parse_cache", "scan_sessions"]


def scan(spark: SparkSession, root: str, state: str, options: Options = Options()) -> Result:
    """Data is written first, caches last, the session's row at the end: a scan that dies is done again.

    A state folder holds one root. A file whose time is known is passed over in an incremental scan; a
    file whose path and bytes are in the parse cache is not parsed; what was read from a file that is
    gone goes, too.
    """
    began = time.time()
    store = K.Snapshots(spark, state)
    with temporary():
        sessions = store.read("scan_sessions", schemas.SCAN_SESSIONS)
        session = K.new_session(spark, sessions, root)
        cache = store.read("file_cache", schemas.FILE_CACHE)
        parse_cache = store.read("parse_cache", schemas.PARSE_CACHE)
        incremental = session > 1 if options.incremental is None else options.incremental
        files = S.listing(spark, root)
        gone = written(cache.select("file_path").join(files.select(F.col("rel_path").alias("file_path")), "file_path", "left_anti"), "gone")
        there = lambda rows: rows.join(gone, "file_path", "left_anti")
        found = S.one_of_hard_links(S.source_files(S.listing(spark, root, with_content=True), options.languages, options.only, options.max_size, options.skip_dirs))
        todo = S.changed_since(found, cache) if incremental else found
        parsed = written(_parsed(todo, parse_cache, options), "parsed")
        functions, variables = S.functions_of_files(parsed, session), S.globals_of_files(parsed, session)
        old, held = there(store.read("functions", schemas.FUNCTIONS)), there(store.read("global_vars", schemas.GLOBAL_VARS))
        redone = parsed.filter("error is null").select("file_path")
        function_changes = K.changes(old.join(redone, "file_path", "left_semi"), functions, K.FUNCTION_KEY)
        variable_changes = K.changes(held.join(redone, "file_path", "left_semi"), variables, K.VARIABLE_KEY)
        rows = functions.drop("dependencies")
        kept = K.repointed(old.join(redone, "file_path", "left_anti") if incremental else old, sessions.select("id").unionByName(spark.createDataFrame([(session,)], "id long")), options.keep_sessions).select(*old.columns)
        store.write("functions", rows.unionByName(kept).dropDuplicates(["id"]))
        edges = store.read("function_deps", schemas.FUNCTION_DEPS)
        store.write("function_deps", S.edges_of(functions).unionByName(edges).dropDuplicates(["caller_id", "callee_name"]).join(store.read("functions", schemas.FUNCTIONS).select(F.col("id").alias("caller_id")), "caller_id", "left_semi"))
        store.write("global_vars", K.upserted(held.join(redone, "file_path", "left_anti"), variables, K.VARIABLE_KEY))
        store.write("file_metrics", file_metrics(K.current_functions(store.read("functions", schemas.FUNCTIONS))))
        seen = parsed.select("file_path", "mtime", F.coalesce("content_hash", F.lit("")).alias("hash"), F.lit(session).cast("long").alias("session_id")).filter("mtime is not null")
        store.write("file_cache", K.upserted(there(cache), seen, ["file_path"]))
        known = parsed.filter("error is null").select("file_path", "language", "content_hash", "encoding", "functions", "globals", F.lit(session).cast("long").alias("session_id"))
        store.write("parse_cache", K.upserted(there(parse_cache), known, ["file_path"]))
        counts = parsed.agg(F.count_if(~F.col("cached")).alias("parsed"), F.count_if("cached").alias("cached"), F.count("error").alias("e")).first()
        totals = distinct_totals(store.read("functions", schemas.FUNCTIONS), store.read("global_vars", schemas.GLOBAL_VARS)).first()
        listed, lost = S.source_files(files, options.languages, options.only, options.max_size, options.skip_dirs).count(), gone.count()
        took = int((time.time() - began) * 1000)
        row = spark.createDataFrame([(session, root, None, took, listed, totals.functions, totals.variables)], schemas.SCAN_SESSIONS).withColumn("scan_time", F.current_timestamp())
        store.write("scan_sessions", K.retained(sessions.unionByName(row), options.keep_sessions))
    for table in TABLES:
        store.drop_old(table, options.keep_snapshots)
    return Result(session, listed, counts.parsed, counts.cached, lost, totals.functions, totals.variables, function_changes, variable_changes, counts.e, took)


def _parsed(todo: DataFrame, parse_cache: DataFrame, options: Options) -> DataFrame:
    """The nested rows of the files to do, and whether the parse cache had them."""
    hashed = todo.withColumn("content_hash", S.bytes_hash())
    if not options.use_parse_cache:
        return S.parse(hashed, options.languages).withColumn("cached", F.lit(False))
    files = hashed.select(F.col("rel_path").alias("file_path"), "language", "mtime", "content_hash", "content")
    key = ["file_path", "language", "content_hash"]
    hits, misses = K.split_by_cache(files, parse_cache.drop("session_id"), key)
    fresh = S.parse(misses.withColumnRenamed("file_path", "rel_path"), options.languages)
    again = hits.withColumn("error", F.lit(None).cast("string")).select(*fresh.columns)
    return fresh.withColumn("cached", F.lit(False)).unionByName(again.withColumn("cached", F.lit(True)))


@dataclass
class Scanned:
    """The relations of a state folder, under the names that the queries take."""

    spark: SparkSession
    state: str

    def _read(self, name: str, schema: str) -> DataFrame:
        return K.Snapshots(self.spark, self.state).read(name, schema)

    functions = property(lambda self: self._read("functions", schemas.FUNCTIONS))
    deps = property(lambda self: self._read("function_deps", schemas.FUNCTION_DEPS))
    globals = property(lambda self: self._read("global_vars", schemas.GLOBAL_VARS))
    sessions = property(lambda self: self._read("scan_sessions", schemas.SCAN_SESSIONS))
    types = property(lambda self: self._read("type_defs", schemas.TYPE_DEFS))
