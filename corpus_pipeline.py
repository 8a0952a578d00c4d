"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, near_dedup, packing, perplexity
from tessera.llm.common import written

#: Near duplicates share this percentage of their five-word shingles; 64 components in 13 chunks meet all pairs at 25
#: differing components or less, 3.8 standard deviations beyond what this similarity gives.
NEAR = {"width": 5, "percent": 80, "k": 64, "chunks": 13}


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return perplexity.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(line_dedup.dedup_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs, **NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "copy")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: SQL cannot express the language model, the signatures or the packing; tests compare each stage with a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
