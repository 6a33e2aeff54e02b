"""Vector best-fit packing of documents into sequences of bounded tokens.

A bin has three residual capacities: tokens, documents, and attention cost (the sum of squared piece
lengths). A piece's needs follow from its length alone, so the search runs on the histogram of lengths,
which has at most ``max_tokens`` entries at any input size, in descending order: of the open bins that
hold the piece under every constraint, the one with the greatest weighted dot product of needs and
residuals normalised by capacity wins, or the one with the least weighted residual norm after placing
(for one binding constraint this is best-fit decreasing); by default several of these rules are tried
on the histogram and the fewest bins win. Bins that are alike are kept
as one group with a count, and a step fills many of them at once; the outcome is the one that placing
pieces one by one gives. The plan (which group takes which ranks of a length) goes to all tasks; its
size is bounded by the number of lengths and groups, not by the input.

Pieces then find their place by their rank among equal lengths: a count per (task, length), prefix
sums over tasks, and a search in the plan. No group of pieces gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import Store
from tidemark.llm._tokens import crc, encoder
from tidemark.llm._words import slices

PIECE_SCHEMA = "part int, rank long, doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids binary"


@dataclass
class Limits:
    """Capacities of a sequence and the weights of its three dimensions in the choice of a bin."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "best"

    def capacity(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2


@dataclass
class Group:
    """``count`` bins that are filled alike."""

    count: int
    left: tuple[int, int, int]
    first: int = 0
    fills: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, first rank, copies a bin, offset


def plan_bins(histogram: dict[int, int], limits: Limits) -> list[Group]:
    """Groups of bins with every length's ranks assigned. Raises if a single piece breaks a constraint."""
    cap = c0, c1, c2 = limits.capacity()
    w0, w1, w2 = limits.weights

    def fits(left, n):
        return left[0] >= n and left[1] >= 1 and left[2] >= n * n

    def scorer(n: int):
        """The score of a bin with ``left`` for pieces of n tokens; the least wins."""
        if limits.rule == "dot":
            k0, k1, k2 = w0 * (n / c0), w1 * (1 / c1), w2 * (n * n / c2)
            return lambda left: -(k0 * (left[0] / c0) + k1 * (left[1] / c1) + k2 * (left[2] / c2))
        return lambda left: w0 * ((left[0] - n) / c0) ** 2 + w1 * ((left[1] - 1) / c1) ** 2 + w2 * ((left[2] - n * n) / c2) ** 2

    def less(left, n):
        return left[0] - n, left[1] - 1, left[2] - n * n

    groups: list[Group] = []
    closed: list[Group] = []
    smallest = min(histogram, default=0)
    for n in sorted(histogram, reverse=True):
        todo, rank, score = histogram[n], 0, scorer(n)
        if not fits(cap, n):
            raise ValueError(f"a piece of {n} tokens breaks a constraint")
        while todo:
            order = nsmallest(2, [(score(g.left), i) for i, g in enumerate(groups) if fits(g.left, n)])
            if order:
                best = groups[order[0][1]]
                rival = order[1][0] if len(order) > 1 else None
            else:
                best = Group(todo, cap)
                groups.append(best)
                rival = None
            copies, left = 0, best.left
            while fits(left, n) and (copies == 0 or not order or score(left) <= min(score(best.left), rival if rival is not None else np.inf)):
                left, copies = less(left, n), copies + 1
            bins = min(best.count, todo // copies)
            if not bins:  # fewer than one bin's copies are left: one bin takes them
                bins, copies = 1, todo
                left = best.left
                for _ in range(copies):
                    left = less(left, n)
            offset = cap[0] - best.left[0]
            if bins < best.count:
                rest = Group(best.count - bins, best.left, 0, list(best.fills))
                split_ranks(best, rest, bins)
                if rest.fills:
                    groups.append(rest)
            best.count = bins
            best.left = left
            best.fills.append((n, rank, copies, offset))
            todo -= bins * copies
            rank += bins * copies
            if best.left[0] < smallest or best.left[1] < 1:
                groups.remove(best)
                closed.append(best)
    groups += closed
    first = 0
    for g in groups:
        g.first = first
        first += g.count
    return groups


#: What the rule "best" tries; the fewest bins win.
TRIALS = (("norm", (1.0, 0.0, 0.0)), ("dot", (1.0, 0.05, 0.05)), ("dot", (0.2, 0.05, 1.0)), ("dot", (0.0, 0.0, 1.0)), ("norm", (1.0, 0.05, 0.5)))


def best_plan(histogram: dict[int, int], limits: Limits) -> list[Group]:
    """The plan by the rule of ``limits``, or for "best" the one of TRIALS with the fewest bins."""
    if limits.rule != "best":
        return plan_bins(histogram, limits)
    tried = [plan_bins(histogram, replace(limits, rule=rule, weights=weights)) for rule, weights in TRIALS]
    return min(tried, key=lambda groups: sum(g.count for g in groups))


def split_ranks(kept: Group, rest: Group, bins: int) -> None:
    """Gives the first ``bins`` bins' ranks to ``kept`` and the others to ``rest``."""
    rest.fills = [(n, rank + bins * copies, copies, offset) for n, rank, copies, offset in kept.fills]


def plan_table(groups: list[Group]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, copies a bin, offset), sorted by rank."""
    rows: dict[int, list] = {}
    for g in groups:
        for n, rank, copies, offset in g.fills:
            rows.setdefault(n, []).append((rank, g.first, copies, offset))
    return {n: np.array(sorted(x), dtype=np.int64) for n, x in rows.items()}


def place(table: np.ndarray, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces of one length by rank."""
    at = table[np.searchsorted(table[:, 0], ranks, side="right") - 1]
    inner = ranks - at[:, 0]
    return at[:, 1] + inner // at[:, 2], at[:, 3] + inner % at[:, 2] * length


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: whole ones of ``most``, after a shorter first one if need be."""
    full, rest = divmod(n, most)
    return ([rest] if rest else []) + [most] * full


def _piecer(tokenizer: str | None, end_id: int, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (most + 1)
        row = 0
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(map(len, texts)):
                out: list[list] = [[] for _ in names]
                for doc_id, raw in zip(docs[a:b], enc.encode(texts[a:b]), strict=True):
                    raw += int(end_id).to_bytes(4, "little")
                    start = 0
                    for piece, n in enumerate(cut_lengths(len(raw) // 4, most)):
                        ids = raw[4 * start : 4 * (start + n)]
                        for column, v in zip(out, (part, seen[n], doc_id, row, piece, start, n, crc(ids), ids if with_ids else None), strict=True):
                            column.append(v)
                        seen[n] += 1
                        start += n
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out, types, strict=True)], names)

    return run


def pack(docs: DataFrame, limits: Limits | None = None, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    A document is its ids with ``end_id`` after them; only those longer than a sequence are cut. Null
    text is empty and has the end id alone; null and repeated doc_ids are documents of their own; an
    empty table has no pieces. ``ids`` (little-endian 32-bit) is null unless ``with_ids``.
    """
    limits = limits or Limits()
    store = Store(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = store.put("pieces", rows.mapInArrow(_piecer(tokenizer, end_id, limits.tokens, with_ids), PIECE_SCHEMA))
    counts = store.put("counts", pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limits.tokens rows
    table = plan_table(best_plan(histogram, limits))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def placer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("length").to_numpy()
            ranks = b.column("rank").to_numpy() + b.column("before").to_numpy()
            seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                own = n == length
                seq[own], off[own] = place(table[int(length)], int(length), ranks[own])
            keep = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(off), b.column("ids")], [*keep, "sequence_id", "offset", "ids"])

    return pieces.join(before, ["part", "length"]).mapInArrow(
        placer, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
    )
