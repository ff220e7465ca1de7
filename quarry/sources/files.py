"""A directory tree of source files as DataFrames: listing, pruning, decoding, extraction.

Everything that prunes reads the listing only (path, length, modification time); contents are read for
the files that are left, once. One Arrow crossing decodes and extracts; the nested result explodes
into functions, edges and globals.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.columns import extension
from quarry.functions.hashing import function_hash, variable_hash
from quarry.schemas import FUNCTIONS, GLOBAL_VARS, PARSED
from quarry.sources.languages import LANGUAGES, Language, by_extension, named

MAX_SIZE = 1 << 20

#: Directories that are never read.
SKIPPED_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "vendor", "third_party", "third-party", "bower_components", "jspm_packages", "typings", "__pycache__", "venv", ".venv", "env", ".env",
    ".tox", ".pytest_cache", ".eggs", ".gradle", ".mvn", "gradle", "bin", "obj", "target", "dist", "build", ".next", ".nuxt", ".idea", ".vscode", ".vs", "cmake-build-debug",
    "cmake-build-release", "out", "__sapper__",
]
#: System directories that are never scanned, nor anything below them.
SYSTEM_ROOTS = [
    "/etc", "/bin", "/boot", "/dev", "/lib", "/lib64", "/proc", "/sbin", "/sys", "/usr", "/var", "/System", "/Library", "/Applications",
]


def check_root(root: str, allow_temp: bool = True) -> str:
    """The absolute root; ValueError for system folders, files and missing paths."""
    path = os.path.abspath(root)
    if path == "/" or any(path.lower() == s.lower() or path.lower().startswith(s.lower() + "/") for s in SYSTEM_ROOTS):
        raise ValueError(f"system folders are not scanned: {path}")
    if not allow_temp and path.startswith(tempfile.gettempdir() + os.sep):
        raise ValueError(f"temporary folders are not scanned: {path}")
    if not os.path.isdir(path):
        raise ValueError(f"not a folder: {path}")
    return path


def relative(path: Column, base: str) -> Column:
    """The part of a path or URI below a base folder, with forward slashes."""
    prefix = re.sub(r"^\w+:/*", "", base.replace("\\", "/")).strip("/") + "/"
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\w+:)?/*", "")
    return F.substring_index(plain, prefix, -1)


def listing(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, rel_path, length, mtime[, content]) of all files below a local or remote root."""
    base = root if re.match(r"\w+://", root) else "file://" + os.path.abspath(root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(base)
    return read.select("path", relative(F.col("path"), base).alias("rel_path"), "length", F.unix_timestamp("modificationTime").alias("mtime"), *(["content"] if with_content else []))


def kept_dirs(rel_path: Column, extra: list[str] | None = None) -> Column:
    """Whether no folder of the path is skipped, hidden or holds a percent sign."""
    skipped = [*SKIPPED_DIRS, *(x.strip() for x in extra or [] if x.strip())]
    parts = F.split(F.replace(rel_path, F.lit("\\"), F.lit("/")), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.exists(dirs, lambda d: d.isin(skipped) | (d.startswith(".") & (d != ".")) | d.contains("%"))


def source_files(files: DataFrame, languages: tuple[Language, ...] = LANGUAGES, only: list[str] | None = None, max_size: int = MAX_SIZE, skip_dirs: list[str] | None = None) -> DataFrame:
    """The files to read, with their language. Templates (.erb) pass every language filter."""
    ext = by_extension(languages)
    name = F.create_map(*[F.lit(x) for e, lang in ext.items() for x in (e, lang.name)])
    out = files.filter(F.col("length") <= max_size).filter(kept_dirs(F.col("rel_path"), skip_dirs)).withColumn("language", F.element_at(name, extension(F.col("rel_path")))).filter("language is not null")
    if only:
        wanted = named(only, languages)
        out = out.filter(F.col("language").isin(*wanted, "erb") if wanted else F.lit(True))
    return out


BROADCAST_PATHS = 100_000


def repeated_links(files: DataFrame) -> DataFrame:
    """(path) of the files (path, inode) whose inode a file with a smaller path has; a null inode is nobody else's."""
    linked = files.filter("inode is not null")
    return linked.join(linked.groupBy("inode").agg(F.min("path").alias("first")), "inode").filter("path <> first").select("path")


def one_of_hard_links(files: DataFrame) -> DataFrame:
    """Of files that are one inode, the first by path. Executors read the inodes of files that are local to them; others have none."""

    def inodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for path in frame["path"]:
                try:
                    stat = os.stat(re.sub(r"^file:/*", "/", path))
                    found.append(f"{stat.st_dev}:{stat.st_ino}" if stat.st_nlink > 1 else None)
                except OSError:
                    found.append(None)
            yield frame.assign(inode=found)[["path", "inode"]]

    again = repeated_links(files.select("path").mapInPandas(inodes, "path string, inode string"))
    # contents stay where they are unless there are very many links
    few = again.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    return files.join(F.broadcast(again) if few else again, "path", "left_anti")


def changed_since(files: DataFrame, file_cache: DataFrame) -> DataFrame:
    """Files whose path and modification second the cache does not have."""
    return files.join(file_cache.select(F.col("file_path").alias("rel_path"), "mtime"), ["rel_path", "mtime"], "left_anti")


def decode(content: bytes) -> tuple[str | None, str]:
    """(text, encoding): byte order marks, BOM-less UTF-16, UTF-8, else Latin text; None for binary content."""
    if content.startswith(b"\xef\xbb\xbf"):
        return _text(content[3:].decode("utf-8", "replace"), "utf-8-bom")
    if content.startswith((b"\xff\xfe", b"\xfe\xff")):
        kind = "utf-16-le" if content[:1] == b"\xff" else "utf-16-be"
        return _text(_utf16(content[2:], kind), kind)
    for kind, zero in (("utf-16-le", 1), ("utf-16-be", 0)):
        if looks_utf16(content, zero):
            return _text(_utf16(content, kind), kind)
    try:
        return _text(content.decode("utf-8"), "utf-8")
    except UnicodeDecodeError:
        head = content[:1024]
        if head and head.count(0) * 5 > len(head):
            return None, "binary"
        return _text(content.decode("latin-1"), "unknown-non-utf8")


def _utf16(content: bytes, kind: str) -> str:
    text = content[: len(content) // 2 * 2].decode(kind, "surrogatepass")
    return text.encode("utf-8", "replace").decode("utf-8").rstrip("\0")


def looks_utf16(content: bytes, zero: int) -> bool:
    """Over 70 % of the first pairs (more than four) have a zero byte at `zero` and another one beside it."""
    head = content[:512]
    pairs = len(head) // 2
    if len(content) % 2 or pairs <= 4:
        return False
    hits = sum(1 for i in range(pairs) if head[2 * i + zero] == 0 and head[2 * i + 1 - zero] != 0)
    return hits * 10 > pairs * 7


def _text(text: str, kind: str) -> tuple[str | None, str]:
    head = text.encode("utf-8")[:512]
    control = sum(1 for b in head if b < 32 and b not in (9, 10, 13))
    return (None, "binary") if control * 10 > 3 * len(head) else (text, kind)


def parse(files: DataFrame, languages: tuple[Language, ...] = LANGUAGES) -> DataFrame:
    """One nested row a file (column content). A file that fails has its error in its row; no file stops the job.

    content_hash is the SHA-256 of the bytes as they were read, taken outside the interpreter.
    """
    by_name = {x.name: x for x in languages}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quarry.functions.extract import functions_of, globals_of

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                row = {"file_path": r.rel_path, "language": r.language, "mtime": r.mtime, "encoding": None, "content_hash": r.content_hash, "functions": [], "globals": [], "error": None}
                try:
                    text, row["encoding"] = decode(bytes(r.content or b""))
                    if text is not None:
                        row["functions"] = [f | {"hash": function_hash(f)} for f in functions_of(text, r.rel_path, by_name[r.language])]
                        row["globals"] = [g | {"hash": variable_hash(g)} for g in globals_of(text, r.rel_path, by_name[r.language])]
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in ["file_path", "language", "mtime", "encoding", "content_hash", "functions", "globals", "error"]])

    hashed = files if "content_hash" in files.columns else files.withColumn("content_hash", bytes_hash())
    return hashed.select("rel_path", "language", "mtime", "content", "content_hash").mapInPandas(run, PARSED)


def bytes_hash() -> Column:
    return F.sha2(F.coalesce("content", F.lit(b"")), 256)


def functions_of_files(parsed: DataFrame, session: int) -> DataFrame:
    """The functions relation, with dependencies; ids come from the natural key, so a retry gives the same ones."""
    rows = parsed.select(F.explode("functions").alias("f")).select("f.*")
    id_ = F.xxhash64(F.lit(session), "file_path", "line_start", "name")
    columns = [c.strip().split(" ")[0] for c in FUNCTIONS.split(", ")]
    return rows.withColumns({"id": id_, "session_id": F.lit(session).cast("long")}).select(*columns, "dependencies")


def edges_of(functions: DataFrame) -> DataFrame:
    return functions.select(F.col("id").alias("caller_id"), F.explode("dependencies").alias("callee_name")).dropDuplicates(["caller_id", "callee_name"])


def globals_of_files(parsed: DataFrame, session: int) -> DataFrame:
    rows = parsed.select(F.explode("globals").alias("g")).select("g.*")
    columns = [c.strip().split(" ")[0] for c in GLOBAL_VARS.split(", ")]
    return rows.withColumns({"id": F.xxhash64(F.lit(session), "file_path", "line_num", "name"), "session_id": F.lit(session).cast("long")}).select(*columns)
