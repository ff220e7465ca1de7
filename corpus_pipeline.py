"""From raw documents to packed training sequences: STAGES, each written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language_id, near_dedup, packing, quality, suffix_dedup
from quarry.llm.shared import discard, place, temporary, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled training rows among its input; documents in no known language go.

    Null and empty texts, and texts without a letter, are in no language and go, as do all texts if no
    row has a label. Ids may be null or repeated: each row is judged by itself, all its columns stay.
    """
    model = language_id.learn(language_id.training_rows(docs))
    return language_id.keep_known(docs, model)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules fail go.

    Null and empty texts have no words and go. Ids may be null or repeated: each row is judged by
    itself, all its columns stay.
    """
    return quality.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by near-duplicate five-word shingle sets, the one with the smallest id stays, one without an id only if none has any.

    Texts without a word (null, empty, white space) are linked with nothing and stay, one of rows equal in id and text. Rows of one
    id with unlinked texts all stay. Of rows linked and equal in id the least hash of id and text decides, of rows equal in text too
    the least of the other columns. Columns may have any names.
    """
    judged = near_dedup.classes(spark, docs)
    words = F.col("n_shingles") > 0
    alone = F.when(~words, F.struct("doc_id", "key"))  # rows without words are linked with nothing
    rows = judged.groupBy(F.when(words, F.col("class")).alias("class"), alone.alias("alone"), "doc_id", "key").agg(F.count("*").alias("n"))
    first = rows.groupBy("class", "alone").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "n")).alias("first"))
    chosen = written(first.select(F.col("first.doc_id").alias("chosen_id"), F.col("first.key").alias("chosen_key"), F.col("first.n").alias("chosen_n")), "chosen")
    held = docs.select(F.struct(*docs.columns).alias("row"))  # whatever its columns are called
    same = F.col("row.doc_id").eqNullSafe(F.col("chosen_id")) & (near_dedup.row_key("row.doc_id", "row.text") == F.col("chosen_key"))
    stay = held.join(chosen, same)
    if not chosen.filter("chosen_n > 1").limit(1).count():
        return stay.select("row.*")
    equal = stay.filter("chosen_n > 1").groupBy("row.doc_id", "row.text").agg(F.min("row").alias("row"))
    return stay.filter("chosen_n = 1").select("row.*").unionByName(equal.select("row.*"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document with a smaller id holds go; a character of which a byte goes goes whole.

    Documents of which nothing is left go, so null and empty texts do. A row without an id loses
    nothing and takes nothing from others; rows that repeat an id take nothing from each other. The
    other columns stay as they are, but for n_chars.
    """
    others = [c for c in docs.columns if c != "text"]
    cut = suffix_dedup.remove_earlier_bytes(spark, docs, carry=others, as_text=True)
    out = cut.select(F.col("kept").alias("text"), *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(others)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns).filter("text <> ''")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left.

    Null and empty texts are one piece of one token. Ids may be null or repeated: each row is packed.
    Only ids and texts are read, whatever the other columns are called.
    """
    import public_tokenizers

    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_rules", keep_good_quality),
    ("near_dedup", keep_one_of_each_group),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Mixtures, sketches and merges are beyond SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the pieces without their ids' bytes, but with their checksum."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary():  # what the stage writes for itself goes once its result is written
            out = stage(spark, docs, sf_dir)
            path = place(spark, name)
            out.write.parquet(path)
        docs = spark.read.parquet(path)
        docs.written_at = path
        if before is not None:
            discard(before)
        before = docs
    return docs.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
