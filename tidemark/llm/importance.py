"""Quality selection by importance resampling with hashed n-gram models.

Two generative models over hashed words and word pairs, one of the target rows and one of all rows,
give every text its importance weight, the ratio of its likelihoods: the sum of the log ratios of its
n-grams. Both models are smoothed by ``SMOOTH`` n-grams a bucket. Gumbel noise from a hash of seed, id and text is added, and the k
rows with the greatest sums are a sample without replacement in proportion to the weights. k defaults
to the share of target rows among labelled ones, of all rows. Both models count all their rows: texts
are dealt by id to meet their labels, unless ``max_targets`` bounds the target rows that count. With
``length``, texts count as if all had that many n-grams (the mean log ratio times ``length``).

Counting is a partial sum per task and bucket; the models are two arrays of ``buckets`` numbers. The top
k are found without a sort: sums are binned, the bin that holds the k-th is found from counts and binned
again, and only the rows of the last, narrow bin are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._store import Store
from tidemark.llm._words import Words, slices, texts_of

BUCKETS = 10_000
SMOOTH = 1.0
#: Widths of the bins of sums and of the bins within the one that holds the k-th.
BIN_WIDTHS = (0.25, 2.0**-20)
_U = np.uint64


def ngrams(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of all pairs within a text, and the text of each."""
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
    single = (words.hash % _U(buckets)).astype(np.int64)
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    pair = (words.grams(2)[inner] % _U(buckets)).astype(np.int64)
    return np.concatenate((single, pair)), np.concatenate((doc, doc[inner]))


def count_ngrams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, n_target): n-grams of all rows of ``docs`` (text, target boolean) and of the target ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            target = np.array([bool(x) for x in batch.column("target").to_pylist()])
            for a, b in slices(map(len, texts), most=8192):
                at, doc = ngrams(Words(texts[a:b]), buckets)
                both[0] += np.bincount(at, minlength=buckets)
                both[1] += np.bincount(at[target[a:b][doc]], minlength=buckets)
        some = np.flatnonzero(both[0])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[0][some]), pa.array(both[1][some])], ["bucket", "n", "n_target"])

    parts = docs.select("text", "target").mapInArrow(run, "bucket long, n long, n_target long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: list, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw by bucket; zeros without a target."""
    raw, target = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    for r in counts:
        raw[r["bucket"]] += r["n"]
        target[r["bucket"]] += r["n_target"]
    if target.sum() == SMOOTH * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray, length: int | None = None) -> DataFrame:
    """Adds n_words and log_weight to ``docs`` (with a column text); null and empty texts have a log weight of 0."""
    base = docs.drop("n_words", "log_weight")
    keep = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(map(len, texts), most=8192):
                words = Words(texts[a:b])
                at, doc = ngrams(words, len(ratios))
                total = np.bincount(doc, ratios[at], b - a)
                if length is not None:
                    total = length * total / np.maximum(1, np.bincount(doc, minlength=b - a))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(words.counts()), pa.array(np.round(total, 9))], [*keep, "n_words", "log_weight"])

    return base.mapInArrow(run, T.StructType(list(base.schema)).add("n_words", "long").add("log_weight", "double"))


def gumbel(seed: int, *cols) -> F.Column:
    """Gumbel noise from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 5, buckets: int = BUCKETS, max_targets: int | None = None, length: int | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text): doc_id, n_words, log_weight, key, selected.

    ``labels`` (doc_id, target boolean) marks target rows; null and false are not. Null ids match no label; repeated rows are rows of
    their own, and equal keys are taken in the order of doc_id and the hash of the text, rows equal in
    all of these together; an empty table gives an empty result. The target model counts all target rows,
    or those of the ``max_targets`` ids with the least hash.
    """
    store = Store(docs.sparkSession, "importance")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = labels.filter("target and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    if max_targets is not None:
        chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_targets)
    chosen = chosen.withColumn("target", F.lit(True)).hint("shuffle_hash")  # texts are dealt by id, but not sorted
    marked = rows.filter("doc_id is not null").join(chosen, "doc_id", "left")
    marked = marked.unionByName(rows.filter("doc_id is null").withColumn("target", F.lit(False)))
    counts = count_ngrams(marked, buckets).collect()  # at most ``buckets`` rows
    weighed = weigh(rows.withColumn("h", F.xxhash64("text")), log_ratios(counts, buckets), length).drop("text")
    weighed = weighed.withColumn("key", F.round(F.col("log_weight") + gumbel(seed, "doc_id", "h"), 9))
    weighed = store.put("weighed", weighed)
    if k is None:
        known = labels.agg(F.count("target").alias("n"), F.sum(F.col("target").cast("int")).alias("good")).first()
        k = round(weighed.count() * (known["good"] / known["n"])) if known["n"] else 0
    last = _last_of(weighed, k)
    if last is None:
        return weighed.withColumn("selected", F.lit(k > 0)).drop("h")
    own = F.struct((-F.col("key")).alias("key"), "doc_id", "h")
    upto = F.struct(F.lit(last["key"]).cast("double").alias("key"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["h"]).cast("long").alias("h"))
    return weighed.withColumn("selected", own <= upto).drop("h")


def _last_of(rows: DataFrame, k: int):
    """The k-th row of ``rows`` (key, doc_id, h) by descending key, or None where k is not within them."""
    inside, before = rows.select((-F.col("key")).alias("key"), "doc_id", "h"), 0
    for width in BIN_WIDTHS:
        inside = inside.withColumn("bin", F.floor(F.col("key") / width))
        bins = inside.groupBy("bin").agg(F.count("*").alias("n"))
        ahead = bins.withColumn("before", F.lit(before) + F.sum("n").over(Window.orderBy("bin")) - F.col("n"))
        edge = ahead.filter((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).select("bin", "before").first()
        if edge is None:
            return None
        inside, before = inside.filter(F.col("bin") == edge["bin"]), edge["before"]
    return inside.orderBy("key", "doc_id", "h").limit(k - before).agg(F.max(F.struct("key", "doc_id", "h")).alias("last")).first()["last"]
