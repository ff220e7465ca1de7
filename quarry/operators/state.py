"""State between scans: upserts by hash, caches, sessions and their retention, as joins and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FUNCTION_KEY = ["file_path", "name", "line_start"]
VARIABLE_KEY = ["file_path", "name", "line_num"]


def upsert_status(old: DataFrame, new: DataFrame, key: list[str], hash_col: str = "hash") -> DataFrame:
    """(key, status): new, unchanged, changed or gone, by one full outer join. Keys are unique on either side."""
    a = old.select(*key, F.col(hash_col).alias("old_hash"), F.lit(True).alias("in_old"))
    b = new.select(*key, F.col(hash_col).alias("new_hash"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "gone").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(*key, status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep_gone: bool = True) -> DataFrame:
    """The next snapshot: new rows in place of old ones with their key."""
    rest = old.join(new.select(*key), key, "left_anti")
    return new.unionByName(rest) if keep_gone else new


def latest_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, in one aggregation."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row")).select(key, "row.*")


def split_by_cache(files: DataFrame, cache: DataFrame, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with their cached rows, files to parse), by path and content hash."""
    key = key or ["file_path", "content_hash"]
    return files.join(cache, key), files.join(cache.select(*key), key, "left_anti")


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> dict[str, int]:
    """How many keys are new, changed, unchanged and gone; of rows with one key the last session's counts."""
    latest = old.groupBy(*key).agg(F.max_by("hash", "session_id").alias("hash"))
    found = upsert_status(latest, new.groupBy(*key).agg(F.min("hash").alias("hash")), key).groupBy("status").count()
    return {r.status: r["count"] for r in found.collect()}  # four rows


def retained(sessions: DataFrame, keep: int = 3) -> DataFrame:
    """The newest sessions by id; `keep` rows, so the order is taken by a top-k, not a sort."""
    return sessions.orderBy(F.desc("id")).limit(keep)


def repointed(rows: DataFrame, sessions: DataFrame, keep: int = 3) -> DataFrame:
    """Rows of dropped sessions move to the newest one."""
    held = retained(sessions, keep).agg(F.max("id").alias("newest"), F.collect_list("id").alias("held"))
    out = rows.crossJoin(F.broadcast(held))  # one row
    return out.withColumn("session_id", F.when(F.array_contains("held", F.col("session_id")), F.col("session_id")).otherwise(F.col("newest"))).drop("newest", "held")


def current_functions(functions: DataFrame) -> DataFrame:
    """Of each file, the functions of its latest session."""
    last = functions.groupBy("file_path").agg(F.max("session_id").alias("session_id"))
    return functions.join(last, ["file_path", "session_id"])


def new_session(spark: SparkSession, sessions: DataFrame, root: str) -> int:
    return (sessions.agg(F.max("id")).first()[0] or 0) + 1


class Snapshots:
    """Tables as numbered Parquet snapshots below a folder; a table's current one is its newest complete snapshot.

    A snapshot counts once its _SUCCESS marker is there, so a reader never sees half of one, and no
    path is overwritten while it is read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def _list(self, table: str) -> list[int]:
        path = self.hadoop.Path(f"{self.folder}/{table}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = [s.getPath() for s in system.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in found if system.exists(self.hadoop.Path(p, "_SUCCESS")))

    def read(self, table: str, schema: str) -> DataFrame:
        """The current snapshot; columns that it lacks are null, an absent table is empty."""
        held = self._list(table)
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/snapshot={held[-1]}")

    def write(self, table: str, rows: DataFrame) -> None:
        number = (self._list(table) or [0])[-1] + 1
        rows.write.parquet(f"{self.folder}/{table}/snapshot={number}")

    def drop_old(self, table: str, keep: int = 2) -> None:
        for number in self._list(table)[:-keep]:
            path = self.hadoop.Path(f"{self.folder}/{table}/snapshot={number}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
