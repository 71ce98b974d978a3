"""The corpus pipeline: five stages, each over all that the one before it kept.

Defined results: a null text is an empty one, and goes only if the classifier rejects it; rows without an id are judged
by their own texts and stay where a stage works by ids (lines, near duplicates); rows that share an id are one document
for these two, and the one with the smallest text stays; ties go to the smallest id. Other columns pass, whatever their
names, up to the last stage. An empty table passes as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.decontaminate import drop_contaminated
from mosaiq.llm.frames import documents, sha_of_text, stored
from mosaiq.llm.jaccard_join import keep_one
from mosaiq.llm.line_dedup import dedup_lines
from mosaiq.llm.quality_mil import keep_good
from mosaiq.llm.queries import tokenizer
from mosaiq.llm.sentencepiece_codec import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; documents that lose all their lines go with them."""
    kept = dedup_lines(docs)
    left = r"[^\x20\x09-\x0D]"
    kept = kept.filter((F.col("n_dropped") == 0) | F.col("text").rlike(left))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return keep_one(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, as packed little-endian unsigned 32-bit integers, and their digests."""
    coded = encode_documents(docs, tokenizer("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), sha_of_text(F.col("decoded")).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: SQL can't express the classifier and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
