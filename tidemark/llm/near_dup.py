"""Near-duplicate groups by banded MinHash with odd sketches, confirmed on full shingle sets.

1. Every text becomes its set of k-word shingles (64-bit hashes), 1024 MinHash samples of it, 32 band
   keys of four samples each, and an odd sketch: the samples folded into 2048 parity bits. The XOR of
   two odd sketches has a population count from which the number of differing samples follows, and
   with it the similarity, most precisely where it is high.
2. Equal sets collapse into a class. Classes that share a band key are candidates: at a similarity of
   0.8 a pair misses all 32 bands with a chance of 5e-8.
3. Links are confirmed on the full sets, from the texts, in rounds that only look across groups not
   yet connected: each class against two pivots of its bucket; then each class and its nearest one by
   sketch in every block of its bucket, twice; then, unless no bucket is open, every pair left that the
   sketch does not rule out.
   A group of near copies therefore costs a number of pairs that follows its size until it is
   connected, and what is not connected by then is compared in full.
4. Buckets are cut into blocks of at most ``BLOCK`` expected members; pairs of blocks are dealt out,
   so a bucket is never one task, and only pairs that pass leave it, from the first band they share.

Texts without words have an empty set and link with nothing. Rows with a null id get null
component ids and are kept; rows repeated with one id each get the row of their own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._graph import components
from tidemark.llm._store import Store
from tidemark.llm._words import Words, mix, shingle_sets, slices, texts_of

BANDS, ROWS, BITS, SAMPLES = 32, 4, 2048, 1024
BLOCK = 2048
#: Standard deviations that a sketch may be off before it rules a pair out.
SLACK = 4.5
_U = np.uint64
_rng = np.random.default_rng(8191)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

SKETCH_SCHEMA = "doc_id long, h long, n_shingles long, fp1 long, fp2 long, keys binary, sketch binary"


def max_xor(threshold: float) -> float:
    """The XOR population count above which a pair is taken to lie under ``threshold``.

    At the threshold the samples differ in a binomial number of places, two sketched values each; the
    parities of d values in BITS bits have mean BITS/2 * (1 - (1 - 2/BITS)^d) and a variance of their own.
    """
    apart = 2 * SAMPLES * (1 - threshold)
    slope = (1 - 2 / BITS) ** apart
    mean, load = BITS / 2 * (1 - slope), apart / BITS
    share = mean / BITS
    own = BITS * share * (1 - share) - BITS * load * np.exp(-4 * load)
    return float(mean + SLACK * np.sqrt(own + slope**2 * 4 * SAMPLES * threshold * (1 - threshold)))


def sketch_slice(texts: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """(set sizes, fingerprint 1, fingerprint 2, band keys, odd sketches) of a few texts."""
    sets, bounds = shingle_sets(Words(texts), k)
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    n = len(texts)
    fp1, fp2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    keys = np.zeros((n, BANDS), dtype=np.uint64)
    bits = np.zeros((n, BITS), dtype=bool)
    if len(some):
        at = bounds[:-1][some]
        fp1[some] = np.add.reduceat(mix(sets), at)
        fp2[some] = np.bitwise_xor.reduceat(mix(sets + _U(0x9E3779B97F4A7C15)), at)
        low = np.empty((SAMPLES, len(some)), dtype=np.uint32)
        half, work = (sets >> _U(32)).astype(np.uint32), np.empty(len(sets), dtype=np.uint32)
        for i in range(SAMPLES):
            np.bitwise_xor(half, _XOR[i], out=work)
            np.multiply(work, _MUL[i], out=work)
            np.minimum.reduceat(work, at, out=low[i])
        low = mix(low.T.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << _U(32)))
        band = low[:, : BANDS * ROWS].reshape(len(some), BANDS, ROWS)
        joint = band[:, :, 0].copy()
        for r in range(1, ROWS):
            joint = mix(joint * _U(3) + band[:, :, r])
        keys[some] = joint
        where = (some[:, None] * BITS + (low >> _U(64 - BITS.bit_length() + 1)).astype(np.int64)).ravel()
        bits = (np.bincount(where, minlength=n * BITS) & 1).astype(bool).reshape(n, BITS)
    return sizes, fp1.view(np.int64), fp2.view(np.int64), keys, np.packbits(bits, axis=1)


def first_shared(keys: np.ndarray, x: np.ndarray, y: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Which pairs meet first in their band: a pair in several buckets counts in one of them only."""
    out = np.zeros(len(x), dtype=bool)
    for s in range(0, len(x), 1 << 15):
        z = slice(s, s + (1 << 15))
        out[z] = (keys[x[z]] == keys[y[z]]).argmax(axis=1) == band[x[z]]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array's rows as a binary column."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in slices(map(len, texts)):
                sizes, fp1, fp2, keys, sketch = sketch_slice(texts[a:b], k)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), batch.column("h").slice(a, b - a), pa.array(sizes), pa.array(fp1), pa.array(fp2), _binary(keys), _binary(sketch)],
                    ["doc_id", "h", "n_shingles", "fp1", "fp2", "keys", "sketch"],
                )

    return run


def _agree(threshold: int):
    """Keeps the pairs (a, b, text_a, text_b) whose full sets meet the threshold, in hundredths."""

    def run_k(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = texts_of(batch.column("text_a")), texts_of(batch.column("text_b"))
                good = np.zeros(len(left), dtype=bool)
                at = 0
                for a, b in slices(len(x) + len(y) for x, y in zip(left, right, strict=True)):
                    sets, bounds = shingle_sets(Words(left[a:b] + right[a:b]), k)
                    n = b - a
                    for i in range(n):
                        x = sets[bounds[i] : bounds[i + 1]]
                        y = sets[bounds[n + i] : bounds[n + i + 1]]
                        if len(x) and len(y):
                            both = np.concatenate((x, y))
                            both.sort()
                            shared = int(np.count_nonzero(both[1:] == both[:-1]))
                            good[at + i] = 100 * shared >= threshold * (len(both) - shared)
                    at += n
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

        return run

    return run_k


def _passing(sk_x, n_x, sk_y, n_y, most: float, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """XOR counts and which pass, for aligned rows of sketches (uint64) and set sizes."""
    apart = np.bitwise_count(sk_x ^ sk_y).sum(axis=-1, dtype=np.int32)
    close = (100 * np.minimum(n_x, n_y) >= threshold * np.maximum(n_x, n_y)) & (apart <= most)
    return apart, close


def _unit_pairs(label, n, sk, side, mode: str, most: float, threshold: int, cross: bool):
    """Pairs of one unit, as index arrays. cross: only between the two sides."""
    out_i, out_j = [], []
    m = len(label)
    step = max(1, (1 << 18) // max(1, m * BITS // 64))
    for s in range(0, m, step):
        rows = np.arange(s, min(m, s + step))
        differ = label[rows][:, None] != label[None, :]
        if cross:
            differ &= side[rows][:, None] != side[None, :]
        if not differ.any():
            continue
        apart, close = _passing(sk[rows][:, None, :], n[rows][:, None], sk[None], n[None, :], most, threshold)
        ok = close & differ
        if mode == "best":
            score = np.where(ok, apart, 1 << 20)
            j = score.argmin(axis=1)
            found = np.flatnonzero(score[np.arange(len(rows)), j] < (1 << 20))
            out_i.append(rows[found])
            out_j.append(j[found])
        else:
            i, j = np.nonzero(ok & (rows[:, None] < np.arange(m)[None, :]))
            out_i.append(rows[i])
            out_j.append(j)
    if not out_i:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _comparer(mode: str, most: float, threshold: int):
    """Candidate pairs of the units in a partition that is sorted by unit; a unit is one pair of blocks."""

    def of_units(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        unit = t.column("unit").to_numpy()
        u2 = t.column("tile").to_numpy()
        node, label, n = (t.column(c).to_numpy() for c in ("node", "label", "n"))
        side, kind = t.column("side").to_numpy(), t.column("kind").to_numpy()
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(unit), -1)
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), dtype=np.uint64).reshape(len(unit), -1)
        band = t.column("band").to_numpy()
        edge = np.flatnonzero((unit[1:] != unit[:-1]) | (u2[1:] != u2[:-1])) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(unit)])))
        left, right = [], []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 24)]):  # small units together, by size
            i, j = np.triu_indices(size, 1)
            some = starts[sizes == size]
            chunk = max(1, (1 << 14) // len(i))
            for c in range(0, len(some), chunk):
                x = (some[c : c + chunk, None] + i[None, :]).ravel()
                y = (some[c : c + chunk, None] + j[None, :]).ravel()
                far = (label[x] != label[y]) & ((kind[x] == 0) | (side[x] != side[y]))
                x, y = x[far], y[far]
                _, ok = _passing(sk[x], n[x], sk[y], n[y], most, threshold)
                left.append(x[ok])
                right.append(y[ok])
        for a, size in zip(starts[sizes > 24], sizes[sizes > 24], strict=True):
            z = slice(a, a + size)
            i, j = _unit_pairs(label[z], n[z], sk[z], side[z], mode, most, threshold, bool(kind[a]))
            left.append(a + i)
            right.append(a + j)
        none = np.zeros(0, dtype=np.int64)
        x, y = np.concatenate(left or [none]), np.concatenate(right or [none])
        keep = first_shared(keys, x, y, band)
        return node[x[keep]], node[y[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = (batch.column("unit")[batch.num_rows - 1].as_py(), batch.column("tile")[batch.num_rows - 1].as_py())
            held.append(batch)
            if last is not None and ends == last and sum(b.num_rows for b in held) < 50 * BLOCK:
                continue
            t = pa.Table.from_batches(held)
            u, v = t.column("unit").to_numpy(), t.column("tile").to_numpy()
            differ = np.flatnonzero((u != u[-1]) | (v != v[-1]))
            cut = int(differ[-1]) + 1 if len(differ) else 0
            last = ends
            if cut:
                a, b = of_units(t.slice(0, cut))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            a, b = of_units(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, h (xxhash64 of the text), n_shingles, component_id, kept.

    Links hold where 100 * intersection >= threshold * union of the k-word shingle sets; component_id
    is the smallest doc_id reachable and kept marks it. Null text is empty; a null doc_id has a null
    component_id and is kept; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "near-dup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store.put("signed", docs.withColumn("h", F.xxhash64("text")).mapInArrow(_sketcher(k), SKETCH_SCHEMA))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = store.put("classes", full.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node")))
    signs = full.select("doc_id", "fp1", "fp2", "n_shingles", "keys", "sketch").dropDuplicates(["doc_id", "fp1", "fp2"])
    reps = store.put(
        "reps",
        classes.join(signs, ["fp1", "fp2", "n_shingles"])
        .filter("doc_id = node")
        .select("node", "fp1", "fp2", F.col("n_shingles").alias("n"), "keys", "sketch"),
    )
    keyed = reps.select(
        "node",
        F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> substring(keys, i * 8 + 1, 8))")).alias("band", "key"),
    ).select("node", F.col("band").cast("int").alias("band"), F.xxhash64("band", "key").alias("unit"))
    busy = keyed.groupBy("unit").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    member = store.put("member", keyed.join(busy, "unit").select("unit", "band", "node", "low", "high"))
    shown = reps.join(member.select("node").distinct(), "node", "left_semi")
    wanted = shown.select(F.col("node").alias("doc_id")).distinct()
    texts = store.put("texts", docs.join(wanted, "doc_id").select(F.col("doc_id").alias("node"), "text"))
    most = max_xor(threshold / 100)
    checked: DataFrame | None = None
    labels: DataFrame | None = None  # (node, label) of nodes whose label is not their own

    def labelled(df: DataFrame) -> DataFrame:
        if labels is None:
            return df.withColumn("label", F.col("node"))
        return df.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    last = ""  # the table of the labels
    stale = False  # a 'best' turn gave no new pairs, so another one would pick the same
    for turn, mode in enumerate(("star", "best", "best", "all")):
        if mode == "best" and stale:
            continue
        now = labelled(member)
        open_ = now.groupBy("unit").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1")
        if turn:
            open_ = store.put(f"open{turn}", open_)
            if not open_.limit(1).count():
                break
        if mode == "star":
            pairs = (
                member.select("node", F.explode(F.array("low", "high")).alias("pivot"))
                .filter("node <> pivot")
                .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
                .distinct()
            )
            side = reps.select("node", "n", "sketch")
            pairs = (
                pairs.join(side.toDF("a", "n_a", "sk_a"), "a")
                .join(side.toDF("b", "n_b", "sk_b"), "b")
                .mapInArrow(_sifter(most, threshold), "a long, b long")
            )
        else:
            pairs = _blocks(now.join(open_.select("unit"), "unit"), reps).mapInArrow(_comparer(mode, most, threshold), "a long, b long").distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = store.put(f"pairs{turn}", pairs)
        if not pairs.limit(1).count():
            stale = mode == "best"
            continue
        checked = pairs if checked is None else checked.union(pairs)
        links = store.put(
            f"links{turn}",
            pairs.join(texts.toDF("a", "text_a"), "a")
            .join(texts.toDF("b", "text_b"), "b")
            .mapInArrow(_agree(threshold)(k), "a long, b long"),
        )
        ends = links.select("a", "b")
        if labels is not None:
            ends = (
                ends.join(labels.toDF("a", "la"), "a", "left")
                .join(labels.toDF("b", "lb"), "b", "left")
                .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
                .filter("a <> b")
                .distinct()
            )
        found = components(store, f"cc{turn}", ends)
        last = f"labels{turn}"
        if labels is None:
            labels = store.put(last, found.filter("node <> label"))
        else:
            moved = found.toDF("label", "to")
            old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            fresh = found.join(labels, "node", "left_anti").select("node", "label")
            labels = store.put(last, old.union(fresh).filter("node <> label"))
    store.keep_only("signed", "classes", last)
    out = signed.select("doc_id", "h", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2", "n_shingles"], "left")
    out = out.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")))
    out = labelled(out).select("doc_id", "h", "n_shingles", F.col("label").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))


def _sifter(most: float, threshold: int):
    """Drops the pairs that sizes or odd sketches rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1) for c in ("sk_a", "sk_b"))
                _, ok = _passing(x, b.column("n_a").to_numpy(), y, b.column("n_b").to_numpy(), most, threshold)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


def _blocks(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Members of open buckets, dealt to units: pairs of blocks of at most about BLOCK members.

    Within a bucket the label of its low pivot is the main one. Members under it (side 1) are only
    compared with the others (side 0), so a connected hot bucket costs one pass over its members.
    """
    main = members.filter("node = low").select("unit", F.col("label").alias("main"))
    sided = members.join(main, "unit").select("unit", "band", "node", "label", (F.col("label") == F.col("main")).cast("int").alias("side"))
    size = sided.groupBy("unit").agg(
        F.ceil(F.sum(1 - F.col("side")) / F.lit(BLOCK)).cast("int").alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.sum("side") / F.lit(BLOCK))).cast("int").alias("core"),
    )
    small = (F.col("rest") == 1) & (F.col("core") == 1)
    own = F.pmod(F.xxhash64("node", "unit"), F.when(F.col("side") == 0, F.col("rest")).otherwise(F.col("core"))).cast("int")
    tiles = F.expr(
        """case when rest = 1 and core = 1 then array(struct(0L as tile, 0 as kind))
        when side = 1 then transform(sequence(0, rest - 1), i -> struct(1000000000000L + i * 1000000L + own as tile, 1 as kind))
        else concat(
          transform(sequence(0, rest - 1), i -> struct(least(i, own) * 1000000L + greatest(i, own) as tile, 0 as kind)),
          transform(sequence(0, core - 1), i -> struct(1000000000000L + own * 1000000L + i as tile, 1 as kind))) end"""
    )
    dealt = sided.join(size, "unit").withColumn("own", F.when(small, F.lit(0)).otherwise(own)).withColumn("at", F.explode(tiles))
    rows = dealt.select("unit", "band", "at.tile", "at.kind", "node", "label", "side").join(reps.select("node", "n", "sketch", "keys"), "node")
    return rows.repartition("unit", "tile").sortWithinPartitions("unit", "tile")
