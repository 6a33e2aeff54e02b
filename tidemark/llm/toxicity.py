"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = logistic(cut_j - x.w): one weight vector for all thresholds, ordered by construction
(cut_{j+1} = cut_j + exp(gap_j)). x holds the distinct lower-cased words of a text and beginnings of words,
hashed to 2^20 numbers; those whose counts among the fitted rows set the grades apart have weights. The
result is the expected severity, the sum of the chances of exceeding each threshold, and the likeliest grade.

The model is fitted on at most ``max_rows`` labelled rows, those with the least hash of their id; the
rest of a larger label table is not used. Executors turn these rows into feature numbers, so no text
comes to the driver. Everything after that covers all rows.

Labels of three or more values are grades as they stand. Binary labels tell no severity, so toxic
rows are graded out of fold: the rows are halved by id, a binary model of each half scores the other,
and the upper half of the toxic scores is grade 2. A row's own label and features never take part in
its grade, but the grade is still a judgement of the text, not an observation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._store import small_batches
from tidemark.llm._words import Words, mix, slices, texts_of

#: Bytes between words: ASCII other than letters and digits.
SPLIT = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
MAX_ROWS = 8_000
BITS = 20
#: Word beginnings of these numbers of bytes are features too: they stand for the inflections of a stem.
STEMS = (5, 6, 7, 8, 9)
_U = np.uint64


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of the distinct features of each text, ascending."""
    w = Words(texts, white=SPLIT)
    doc, size = w.docs(), w.end - w.start
    docs, codes = [doc], [w.hash]
    for n in STEMS:
        some = np.flatnonzero(size > n)
        docs.append(doc[some])
        codes.append(mix(w.hash_of(w.start[some], w.start[some] + n) ^ _U(n << 32)))
    both = np.unique((np.concatenate(docs).astype(_U) << _U(BITS)) | (np.concatenate(codes) >> _U(64 - BITS)))
    return (both >> _U(BITS)).astype(np.int64), (both & _U((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Ordinal:
    """A fitted model: the weights of feature numbers, and the ascending cut points."""

    weights: dict[int, float]
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """Chances of exceeding each cut."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -30, 30)))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[list(self.weights)] = list(self.weights.values())
        return out


def select_features(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, least_z: float = 4.5) -> np.ndarray:
    """Features of at least five rows whose share among toxic rows differs by ``least_z`` standard errors."""
    n, m = len(toxic), int(toxic.sum())
    if not 0 < m < n:
        return np.zeros(0, dtype=np.int64)
    p = m / n
    seen, bad = np.bincount(col, minlength=1 << BITS), np.bincount(col[toxic[row] > 0], minlength=1 << BITS)
    apart = np.abs(bad - seen * p) / np.sqrt(np.maximum(seen, 1) * p * (1 - p))
    return np.flatnonzero((seen >= 5) & (apart >= least_z))


def fit(row: np.ndarray, col: np.ndarray, grades: np.ndarray, chosen: np.ndarray, levels: int, ridge: float = 0.02, steps: int = 300) -> Ordinal:
    """Maximum likelihood over rows with the features (row, col) by weights of ``chosen``, with a ridge penalty, by Adam on the whole gradient."""
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    own = place[col] >= 0
    row, col = row[own], place[col[own]]
    counts = np.bincount(grades, minlength=levels) + 0.5
    share = np.cumsum(counts)[:-1] / counts.sum()
    start = np.log(share / (1 - share))
    theta = np.concatenate((np.zeros(len(chosen)), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    d, n = len(chosen), len(grades)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate(([0.0], np.cumsum(gaps)))
        eta = np.bincount(row, theta[col], n)
        low = np.concatenate(([-np.inf], cuts))[grades] - eta
        high = np.concatenate((cuts, [np.inf]))[grades] - eta
        f_low, f_high = (1 / (1 + np.exp(-np.clip(u, -30, 30))) for u in (low, high))
        f_low, f_high = np.where(np.isneginf(low), 0, f_low), np.where(np.isposinf(high), 1, f_high)
        p = np.maximum(f_high - f_low, 1e-12)
        g_low, g_high = f_low * (1 - f_low), f_high * (1 - f_high)
        d_eta = (g_high - g_low) / p
        d_cut = np.zeros(levels - 1)
        np.add.at(d_cut, np.minimum(grades, levels - 2), np.where(grades < levels - 1, -g_high / p, 0))
        np.add.at(d_cut, np.maximum(grades - 1, 0), np.where(grades > 0, g_low / p, 0))
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, d_eta[row], d) + ridge * theta[:d], [tail[0]], tail[1:] * gaps)) / n
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    cuts = theta[d] + np.concatenate(([0.0], np.cumsum(np.exp(theta[d + 1 :]))))
    return Ordinal(dict(zip(chosen.tolist(), theta[:d].tolist(), strict=True)), cuts)


def out_of_fold_grades(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, half: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """0, 1 and 2 from binary labels; ``half`` tells the two halves of the rows."""
    score = np.zeros(len(toxic))
    for side in (0, 1):
        keep = half[row] == side
        number = np.cumsum(half == side) - 1
        w = fit(number[row[keep]], col[keep], toxic[half == side], chosen, 2).dense()
        other = ~keep
        score[half != side] = np.bincount(row[other], w[col[other]], len(toxic))[half != side]
    grades = toxic.copy()
    if grades.any():
        grades[(toxic == 1) & (score > np.median(score[toxic == 1]))] = 2
    return grades


def labelled_features(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) pairs, labels and halves of at most ``max_rows`` labelled rows of ``docs`` (doc_id, text).

    Of rows repeated with one id the one with the least hash of its text counts, of repeated labels the greatest.
    """
    small_batches(docs.sparkSession)
    at = F.xxhash64(F.lit(11), "doc_id")
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(at, "doc_id").limit(max_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(map(len, texts), most=4096):
                row, col = features(texts[a:b])
                ends = np.searchsorted(row, np.arange(b - a + 1))
                raw = [col[x:y].astype("<u4").tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "toxic", "h")), pa.array(raw, pa.binary())], ["doc_id", "toxic", "h", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")
    made = rows.select("doc_id", "toxic", "h", "text").mapInArrow(run, "doc_id long, toxic int, h long, own binary")
    made = made.groupBy("doc_id", "toxic").agg(F.min(F.struct("h", "own")).alias("x"))
    got = made.select("doc_id", "toxic", "x.own", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(2)).cast("int").alias("half")).orderBy("doc_id").collect()  # max_rows at most, each of 2^20 features at most
    each = [np.frombuffer(r["own"], dtype="<u4").astype(np.int64) for r in got]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return row, np.concatenate(each or [np.zeros(0, dtype=np.int64)]), np.array([r["toxic"] for r in got], dtype=int), np.array([r["half"] for r in got], dtype=int)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ordinal:
    """The model of ``labels`` (doc_id, toxic from 0 up); without two kinds of labels it finds nothing toxic."""
    row, col, grades, half = labelled_features(docs, labels, max_rows)
    chosen = select_features(row, col, (grades > 0).astype(int))
    if not len(chosen):
        return Ordinal({}, np.array([20.0, 21.0]))
    if grades.max() < 2:
        grades = out_of_fold_grades(row, col, grades, half, chosen)
    return fit(row, col, grades, chosen, int(max(2, grades.max())) + 1)


def score_toxicity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Adds expected_severity (0 to the number of cuts), grade and toxic to ``docs`` (with a column text).

    Null and empty texts have no features. toxic: grade 1 or more is likelier than grade 0. Columns of
    these names are replaced; all other columns stay.
    """
    small_batches(docs.sparkSession)
    names = ("expected_severity", "grade", "toxic")
    base = docs.drop(*names)
    keep = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(map(len, texts), most=4096):
                row, col = features(texts[a:b])
                above = model.above(np.bincount(row, weights[col], b - a))
                p = -np.diff(np.concatenate((np.ones((b - a, 1)), above, np.zeros((b - a, 1))), axis=1), axis=1)
                own = batch.slice(a, b - a)
                cols = [pa.array(np.round(above.sum(axis=1), 6)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] > 0.5)]
                yield pa.RecordBatch.from_arrays([*own.columns, *cols], [*keep, *names])

    schema = T.StructType(list(base.schema)).add("expected_severity", "double").add("grade", "integer").add("toxic", "boolean")
    return base.mapInArrow(run, schema)
