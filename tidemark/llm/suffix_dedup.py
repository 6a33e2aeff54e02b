"""Repeated passages by a sparse suffix array: minimiser suffixes, sorted, neighbours compared, matches extended left and right.

1. Suffixes are retained where content says so: at the minimiser (least hash) of every window of
   ``WINDOW`` five-word grams. Every passage of ``least`` words is owned by the retained suffix of its
   first window, so it has at least ``least - WINDOW + 1`` words to the right of the suffix's place, its stem,
   and up to WINDOW - 1 words to the left. Equal passages are owned at the same word.
2. The array is ordered by stem (as one hash) and then by the words that follow. Suffixes alone with their stem
   leave first, by a minimum and a maximum per stem. The others take their context along: the words
   before their place and after their stem, as far as the passages that they own reach.
3. Suffixes with equal stem and context are one entry (with its first and last place), so that a hot
   group of copies is one row. Entries are sorted; the common prefix of neighbours says how far each
   match extends to the right, and within the entries that agree so far, the order of the words to the left says how far
   it extends to the left. Where both together make ``least`` words, all places of the entries repeat.
4. Stems with more than ``heavy`` different contexts (a phrase that is everywhere) never stand in one task:
   their entries are dealt by each extension (so many words left, the rest right) and matched by its hash.
5. Spans are the unions of the passages found, so matches of any length are found in full.

Repeats count within one document and across documents. Words are compared as they are written; stems
and extensions to the left are compared by 64-bit hashes, words to the right by 32 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import Store
from tidemark.llm._words import Words, mix, slices, texts_of

LEAST = 50
WINDOW = 24
GRAM = 5
_U = np.uint64
REACH = WINDOW - 1
#: Contexts of one stem that are compared in one task.
HEAVY = 1000


def gram_starts(words: Words, k: int) -> np.ndarray:
    """Word numbers at which k words of one text follow."""
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
    return np.flatnonzero(np.arange(len(words.hash)) + k <= words.first[1:][doc])


def least_grams(words: Words, starts: np.ndarray) -> np.ndarray:
    """Word number of the least gram of the WINDOW grams from each start (the first of equal ones)."""
    grams = words.grams(GRAM)
    best, at = grams[starts], starts.copy()
    for j in range(1, WINDOW):
        own = grams[starts + j]
        less = own < best
        best[less], at[less] = own[less], starts[less] + j
    return at


def owners(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the retained suffixes that own passages, and the first and last start of these."""
    starts = gram_starts(words, least)
    at, first, n = np.unique(least_grams(words, starts), return_index=True, return_counts=True)
    return at, starts[first], starts[first + n - 1] if len(first) else starts


def _anchors(least: int):
    """The stems of the retained suffixes: (key, doc_id, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for a, b in slices(map(len, texts)):
                words = Words(texts[a:b], fold=False)
                at, _, _ = owners(words, least)
                key = words.grams(least - REACH)[at]
                doc = words.docs()[at]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[a:b][doc]), pa.array((at - words.first[doc]).astype(np.int32))], ["key", "doc_id", "pos"])

    return run


def _runs(codes: np.ndarray, start: np.ndarray, n: np.ndarray, step: int) -> pa.Array:
    """Binary values: for each row the ``n`` codes from ``start`` on, forwards or backwards."""
    ends = np.concatenate(([0], np.cumsum(n)))
    inner = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
    raw = codes[np.repeat(start, n) + step * inner]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def _contexts(least: int):
    """The suffixes at the places ``at`` with their context: (key, doc_id, pos, left, right), words of 32 bits."""
    stem = least - REACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            stay = batch.column("at")
            for a, b in slices(map(len, texts)):
                words = Words(texts[a:b], fold=False)
                kept = np.concatenate([np.asarray(stay[i].as_py(), dtype=np.int64) + words.first[i - a] for i in range(a, b)])
                at, low, high = owners(words, least)
                some = np.isin(at, kept)
                at, low, high = at[some], low[some], high[some]
                codes = (words.hash >> _U(32)).astype("<u4")
                doc = words.docs()[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words.grams(stem)[at].view(np.int64)), pa.array(ids[a:b][doc]), pa.array((at - words.first[doc]).astype(np.int32)),
                        _runs(codes, at - 1, at - low, -1), _runs(codes, at + stem, REACH - (at - high), 1),
                    ],
                    ["key", "doc_id", "pos", "left", "right"],
                )

    return run


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of a binary column in rows of REACH, zeros beyond, and their numbers."""
    raw = [x or b"" for x in column.to_pylist()]
    n = np.fromiter((len(x) // 4 for x in raw), dtype=np.int64, count=len(raw))
    wide = b"".join(x.ljust(4 * REACH, b"\0") for x in raw)
    return np.frombuffer(wide, dtype="<u4").reshape(len(raw), REACH), n


def match_entries(t: pa.Table) -> pa.RecordBatch:
    """Matches among entries that come sorted by key and right: (entry, j_from, j_to, doc, pos, high).

    The entry's passages with j_from to j_to words to the left of its place repeat; doc and pos are the
    first place of the suffix among those that agree, high the greatest doc_id among them.
    """
    key = t.column("key").to_numpy()
    left, nl = _codes(t.column("left").combine_chunks())
    right, nr = _codes(t.column("right").combine_chunks())
    low_doc, low_pos, high_doc, high_pos = (t.column(c).to_numpy() for c in ("low_doc", "low_pos", "high_doc", "high_pos"))
    n = len(key)
    common = np.zeros(n, dtype=np.int64)  # words that the neighbour before has in common beyond the stem
    same = np.cumprod(right[1:] == right[:-1], axis=1).sum(axis=1)
    common[1:] = np.where(key[1:] == key[:-1], np.minimum(same, np.minimum(nr[1:], nr[:-1])), -1)
    common[:1] = -1
    before = mix(key.view(np.uint64))
    found: list[tuple[np.ndarray, ...]] = []
    for j in range(REACH + 1):
        if j:
            before = mix(before * _U(0x9E3779B97F4A7C15) + left[:, j - 1].astype(_U) + _U(1))
        r = REACH - j
        run = np.cumsum(common < r)
        some = np.flatnonzero((nl >= j) & (nr >= r))
        if not len(some):
            continue
        order = some[np.lexsort((low_pos[some], low_doc[some], before[some], run[some]))]
        edge = np.ones(len(order), dtype=bool)
        edge[1:] = (run[order[1:]] != run[order[:-1]]) | (before[order[1:]] != before[order[:-1]])
        head = np.flatnonzero(edge)
        group = np.cumsum(edge) - 1
        first = order[head][group]
        apart = (high_doc[order] != low_doc[first]) | (high_pos[order] != low_pos[first]) | (low_doc[order] != low_doc[first]) | (low_pos[order] != low_pos[first])
        hit = np.logical_or.reduceat(apart, head)[group]
        most = np.maximum.reduceat(high_doc[order], head)[group]
        found.append((order[hit], np.full(int(hit.sum()), j), low_doc[first][hit], low_pos[first][hit], most[hit]))
    cols = [np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, dtype=np.int64) for i in range(5)]
    order = np.lexsort((cols[1], cols[0]))
    entry, j, doc, pos, most = (c[order] for c in cols)
    edge = np.ones(len(entry), dtype=bool)
    edge[1:] = (entry[1:] != entry[:-1]) | (j[1:] != j[:-1] + 1) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (most[1:] != most[:-1])
    head = np.flatnonzero(edge)
    tail = np.append(head[1:], len(entry))[: len(head)] - 1
    out = [t.column("entry").to_numpy()[entry[head]], j[head], j[tail], doc[head], pos[head], most[head]]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], [c.split()[0] for c in MATCHES.split(", ")])


MATCHES = "entry long, j_from long, j_to long, doc long, pos long, high long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of entries that come sorted by key and right, stem by stem; a stem has at most HEAVY of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield match_entries(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield match_entries(pa.Table.from_batches(held))


def _by_extension(entries: DataFrame) -> DataFrame:
    """What match_entries finds, for stems of any number of entries: each extension is dealt out by its hash."""
    j = F.sequence(F.lit(REACH) - F.expr("octet_length(right) div 4").cast("int"), F.expr("octet_length(left) div 4").cast("int"))
    rows = entries.withColumn("j", F.explode(j))
    rows = rows.withColumn("h", F.xxhash64("key", "j", F.substring("left", F.lit(1), 4 * F.col("j")), F.substring("right", F.lit(1), 4 * (REACH - F.col("j")))))
    low, high = F.struct("low_doc", "low_pos"), F.struct("high_doc", "high_pos")
    groups = rows.groupBy("h").agg(F.min(low).alias("first"), F.max(high).alias("last")).filter("first.low_doc <> last.high_doc or first.low_pos <> last.high_pos")
    near = rows.select("h", "entry", "j").join(groups, "h")
    return near.select("entry", F.col("j").cast("long").alias("j_from"), F.col("j").cast("long").alias("j_to"), F.col("first.low_doc").alias("doc"), F.col("first.low_pos").alias("pos"), F.col("last.high_doc").alias("high"))


def _merge(least: int):
    """Spans of ranges of passages (doc_id, p_from, p_to, extra, other) that come sorted by doc_id and p_from."""
    names = ("doc_id", "start", "end", "n_words", "removable", "other_doc_id")

    def spans(t: pa.Table) -> pa.RecordBatch:
        low, n = t.column("p_from").to_numpy(), t.column("p_to").to_numpy() - t.column("p_from").to_numpy() + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc, pos, other = np.repeat(t.column("doc_id").to_numpy(), n), np.repeat(low, n) + inner, np.repeat(t.column("other").to_numpy(), n)
        extra = np.repeat(t.column("extra").to_numpy(zero_copy_only=False), n)
        order = np.lexsort((pos, doc))  # as they come, but for rows repeated with one id
        doc, pos, other, extra = doc[order], pos[order], other[order], extra[order]
        begins = np.ones(len(doc), dtype=bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + least)
        head = np.flatnonzero(begins)
        tail = np.append(head[1:], len(doc)) - 1
        span = np.cumsum(begins) - 1
        again = np.flatnonzero(extra)
        reach = np.full(len(again), least, dtype=np.int64)
        same = span[again][1:] == span[again][:-1]
        reach[:-1][same] = np.minimum(least, np.diff(pos[again])[same])
        removable = np.bincount(span[again], reach, len(head)).astype(np.int64)
        end = pos[tail] + least
        cols = [doc[head], pos[head], end, end - pos[head], removable, np.minimum.reduceat(other, head)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            doc = t.column("doc_id").to_numpy()
            cut = int(np.searchsorted(doc, doc[-1]))
            if cut:
                yield spans(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def repeated_passages(docs: DataFrame, least: int = LEAST, heavy: int = HEAVY) -> DataFrame:
    """One row per maximal span of ``docs`` (doc_id, text) made of passages of ``least`` words that stand at another place too, in this document or another.

    doc_id, start and end (word numbers, end exclusive), n_words, removable (words of the span that stand
    in passages which are not their first occurrence by doc_id and place) and other_doc_id: the least
    doc_id that shares a passage, or the greatest one where the document itself is least (itself, where
    no other document has the passage). Null, empty and short texts have no spans; rows with a null id
    are left out; rows repeated with one id are one document, whose places are told by their word
    numbers; an empty table gives an empty result. Other columns are not read.
    """
    if least < WINDOW + GRAM:
        raise ValueError(f"least must be {WINDOW + GRAM} or more")
    store = Store(docs.sparkSession, "suffixes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    anchors = store.put("anchors", rows.mapInArrow(_anchors(least), "key long, doc_id long, pos int"))
    ends = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "pos") for f, n in ((F.min, "min"), (F.max, "max"))]
    shared = store.put("shared", anchors.groupBy("key").agg(*ends).filter("min_doc_id <> max_doc_id or min_pos <> max_pos").select("key"))  # a table, so that the join deals both sides itself and splits hot keys
    stay = store.put("stay", anchors.join(shared, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("at")))  # a document's own places: as many as its words allow
    store.drop("anchors", "shared")
    store.release()
    members = rows.join(stay, "doc_id").mapInArrow(_contexts(least), "key long, doc_id long, pos int, left binary, right binary")
    members = store.put("members", members.withColumn("entry", F.xxhash64("key", "left", "right")))
    store.drop("stay")
    store.release()
    place = F.struct("doc_id", F.col("pos").cast("long").alias("pos"))
    entries = members.groupBy("key", "entry").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.min(place).alias("low"), F.max(place).alias("high"))
    entries = store.put("entries", entries.select("key", "entry", "left", "right", *(F.col(f"{x}.{c}").alias(f"{x}_{n}") for x in ("low", "high") for c, n in (("doc_id", "doc"), ("pos", "pos")))))
    store.release()
    crowds = store.put("crowds", entries.groupBy("key").count().filter(F.col("count") > heavy).select("key"))
    small = entries.join(crowds, "key", "left_anti").repartition("key").sortWithinPartitions("key", "right")
    matches = store.put("matches", small.mapInArrow(_neighbours, MATCHES).unionByName(_by_extension(entries.join(crowds, "key", "left_semi"))))
    store.drop("entries", "crowds")
    store.release()
    hits = members.select("entry", "doc_id", F.col("pos").cast("long").alias("at")).join(matches, "entry").select(
        "doc_id", (F.col("at") - F.col("j_to")).alias("p_from"), (F.col("at") - F.col("j_from")).alias("p_to"),
        ((F.col("doc_id") != F.col("doc")) | (F.col("at") != F.col("pos"))).alias("extra"),
        F.when(F.col("doc_id") == F.col("doc"), F.col("high")).otherwise(F.col("doc")).alias("other"),
    )
    hits = hits.repartition("doc_id").sortWithinPartitions("doc_id", "p_from")
    return hits.mapInArrow(_merge(least), "doc_id long, start long, end long, n_words long, removable long, other_doc_id long")
