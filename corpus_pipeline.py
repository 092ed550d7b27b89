"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidline.llm import decontaminate, line_dedup, packing, quality, simhash
from braidline.llm.common import save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits in which the fingerprints of near-duplicates may differ.
BITS = 4


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs, keep=list(COLUMNS)).where("kept").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each class of near-duplicates: nulls last, then by text hash and the other columns.

    A class is what SimHash links, as op7 does, and what shingle sets link beyond the reach of its bits.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = simhash.near_classes(docs, bits=BITS).groupBy("root").agg(F.min(row).alias("row")).select(F.xxhash64("row.doc_id", "row.text_hash").alias("row_key"))
    kept = docs.withColumn("row_key", F.xxhash64("doc_id", F.xxhash64("text"))).join(first, "row_key", "left_semi")
    # Rows of one id and one text have one key.
    turn = F.row_number().over(Window.partitionBy("row_key").orderBy("lang", "source", "n_chars"))
    return kept.withColumn("turn", turn).where("turn = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), bench)
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("id"), "text_hash")
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_windows),
]

#: Shingle sets, fingerprints and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
