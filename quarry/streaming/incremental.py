"""Incremental scans as a stream: new files of a folder are parsed once, however often it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources import files as S
from quarry.sources.languages import LANGUAGES


def file_stream(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """The files below a root as they appear, in the shape of sources.files.listing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root)
    return read.select("path", S.relative(F.col("path"), root).alias("rel_path"), "length", F.unix_timestamp("modificationTime").alias("mtime"), "content")


def parse_new_files(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse all files that earlier runs have not seen, append their nested rows, and stop."""
    parsed = S.parse(S.source_files(file_stream(spark, root), LANGUAGES))
    return parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
