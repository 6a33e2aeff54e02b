"""Queries of the ten operators over the tables they are meant for, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oracles
from tidemark.llm.importance import resample
from tidemark.llm.line_quality import clean_documents
from tidemark.llm.media import document_media, interleave
from tidemark.llm.mixing import mix_documents
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.secrets import scan, summarise
from tidemark.llm.suffix_dedup import repeated_passages
from tidemark.llm.token_store import read_tokens, write_tokens
from tidemark.llm.toxicity import score_toxicity, train


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).drop("text")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(_documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(_documents(spark, sf_dir).select("doc_id", "text")).drop("text", "cleaned")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir), least=50)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(_documents(spark, sf_dir).select("doc_id", "text"))


def media_page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its ordered text and media items."""
    pages = interleave(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return pages.select("page_id", F.explode("items").alias("x")).select("page_id", "x.*")


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("target"))
    return resample(_documents(spark, sf_dir), target)


def op7_token_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(_documents(spark, sf_dir), end_id=0))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(scan(_documents(spark, sf_dir).select("doc_id", "text")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), end_id=2, with_ids=False).drop("ids")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), k=4, threshold=80).drop("h")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_ordinal": op1_toxicity_ordinal,
        "op2_source_mixing": op2_source_mixing,
        "op3_line_quality": op3_line_quality,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_media_columns": op5_media_columns,
        "media_page_sequences": media_page_sequences,
        "op6_importance_resampling": op6_importance_resampling,
        "op7_token_bit_packing": op7_token_bit_packing,
        "op8_secret_scan": op8_secret_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_array_dedup": oracles.REPEATED, "op8_secret_scan": oracles.secret_scan(), "op10_minhash_near_dedup": oracles.NEAR_DUP}
