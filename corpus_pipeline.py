"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing, in this order.

Every stage takes (spark, docs, sf_dir), works on all of ``docs`` and, but for the last, returns its
columns; between stages the rows are a Parquet table in the shared folder. SQL cannot express the
fitted model or the tokenizer, so there is no ORACLE_SQL; tests/llm/test_pipeline.py compares the run
with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_dup, packing, secrets, toxicity
from tidemark.llm._store import Store

ORACLE_SQL = None


def _with_row(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the whole row, so that no other column meets the operators' own."""
    return docs.select("doc_id", "text", F.struct(*map(F.col, docs.columns)).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not find toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(_with_row(docs), model).filter("not toxic").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more); rows without an id stay."""
    groups = near_dup.near_duplicates(docs.select("doc_id", "text"), k=5, threshold=80)
    stay = groups.filter("kept and doc_id is not null").select(F.col("doc_id").alias("stay_id"), F.col("h").alias("stay_h")).distinct()
    rows = _with_row(docs).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "row")
    named = rows.join(stay, (F.col("id") == F.col("stay_id")) & (F.col("h") == F.col("stay_h")), "left_semi")
    one = named.groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))  # of rows repeated with one id and text, by a hash of the row
    return one.select("row").unionByName(rows.filter("id is null").select("row")).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the name of its kind in the place of every secret; n_chars follows the text."""
    rest = F.struct(F.lit(0).alias("none"), *(F.col(c) for c in docs.columns if c != "text"))
    clean = secrets.redact(secrets.scan(docs.select("text", rest.alias("rest"))))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return clean.select(*(own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.expand(mixing.mix_documents(docs, carry=True)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.put(name, stage(spark, docs, sf_dir))
    return docs
