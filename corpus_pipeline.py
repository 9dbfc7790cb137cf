"""The corpus pipeline: stages over ``documents``, each written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontam, language_id, line_dedup, near_copies, sp_codec


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    common.small_batches(spark)
    return language_id.filter_language(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    common.small_batches(spark)
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Near duplicates share 0.8 of their five-word shingles. SimHash fingerprints within four bits are found by op10's
    pigeonring and checked exactly; prefix filtering adds the pairs that lie further apart. op10's
    contract (four words, four bits and no check) is that of its query only.
    """
    common.small_batches(spark)
    return near_copies.keep_one(docs, words=5, least=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    common.small_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids, their number, and whether decoding gives back the text."""
    common.small_batches(spark)
    return sp_codec.encode_checked(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: Stages here fit a model and segment by merges, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(spark, lambda: stage(spark, docs, sf_dir), name)
    return docs
