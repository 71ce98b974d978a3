"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import documents, sha_of_text
from .oracles import HARD_NEGATIVES_SQL, URL_FILTERS_SQL, quality_rules_sql

#: Where the public tokenizers' files are; a parameter of the operators that need one.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer(name: str) -> str:
    """The place of a tokenizer's file."""
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    coded = encode_documents(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        sha_of_text(F.col("decoded")).alias("decoded_sha256"),
        F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), shingle=3, percent=90)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    found = remove_repeats(documents(spark, sf_dir), window=50)
    return found.select("doc_id", "n_words", "n_removed", sha_of_text(F.col("kept")).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digest

    return line_digest(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import RESULT, judge

    return judge(documents(spark, sf_dir)).select(*RESULT)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mil import THRESHOLD, held_out, score_documents, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = F.col("quality_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge_captures, sample_history, with_fetch_time

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_captures(with_fetch_time(pages), sample_history(pages)).select("page_id", "url", "n_active", "entry", "blocked")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed ends at the whole table, whatever it goes through: all documents are inserted, some of them with a stale
    count; then the stale are revised to the whole text's count, and some are deleted and inserted again. Batches
    come out of order and twice.
    """
    import uuid

    from .frames import shared_dir, stored
    from .token_rollup import Rollup, count_tokens, deleted, inserted

    versions = {"piece_bpe_32k@1": ("pieces", tokenizer("piece_bpe_32k.model")), "byte_bpe_50k@1": ("ranks", tokenizer("byte_bpe_50k.tiktoken"))}
    docs = documents(spark, sf_dir)
    counts = stored(count_tokens(docs, versions), "counts")
    gone, stale = F.xxhash64("doc_id") < -(1 << 62), F.xxhash64("doc_id") > 1 << 62
    # A stale count is off by one: the first batch says so, the second one sets it right.
    first = inserted(counts.withColumn("n_tokens", F.when(stale, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))))
    right = inserted(counts.filter(stale)).withColumn("tokens_before", F.col("tokens_after") + 1)
    changes = right.unionByName(deleted(counts.filter(gone)))
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for batch, rows in (("0001", first), ("0002", changes), ("0003", inserted(counts.filter(gone))), ("0002", changes), ("0001", first)):
        rollup.commit(batch, rows)
        if batch == "0003":
            rollup.compact()  # the replays meet batches that were folded
    return rollup.totals()


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import SCORE, THRESHOLD, held_out, score_documents, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_url_filters": op2_url_filters, "op3_token_counts": op3_token_counts, "op4_decontamination": op4_decontamination, "op9_jaccard_join": op9_jaccard_join, "op7_substring_dedup": op7_substring_dedup, "op5_line_dedup": op5_line_dedup, "op10_quality_rules": op10_quality_rules, "op6_quality_classifier": op6_quality_classifier, "op8_html_extraction": op8_html_extraction, "op11_toxicity": op11_toxicity, "op12_embedding_whitening": op12_embedding_whitening, "op13_hard_negatives": op13_hard_negatives}
ORACLES: dict[str, str] = {"op2_url_filters": URL_FILTERS_SQL, "op10_quality_rules": quality_rules_sql(), "op13_hard_negatives": HARD_NEGATIVES_SQL}
