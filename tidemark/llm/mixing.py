"""Mixing sources to target weights by Efraimidis-Spirakis order.

Each source has a target of words. A document's key is exponential, -ln(u) / weight, with u from a
hash of the seed, id and text, so that reruns agree; ascending keys are the order of a weighted sample
without replacement. Where a target exceeds the source's size, whole epochs of every document come
first; the remainder is taken in key order while the prefix sum of sizes is within it. What is then
missing, less than the next document, goes to the one document of the same bin that comes nearest to
it, or to none if that is nearer still.

The prefix sums need no sort of a source: keys are binned by their distribution (about ``BIN_DOCS``
documents a bin, from the source's count, for weights of any size), bins are summed and prefix-summed, and only documents of
the one bin that holds the cut are sorted. A hot source thus costs one bin's sort. What is known of a
source (its plan, its cut) is a stored table of one row a source: Spark sees its size, broadcasts it where it
is small and splits the hot source's side of the join where it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import Store

WORD = r"[^\x20\x09-\x0D]+"
BIN_DOCS = 20_000
#: Keys are binned at all of these scales together, so that weights of any size spread over bins.
SCALES = (1e3, 1.0, 1e-3, 1e-6, 1e-9)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_weight(text: Column) -> Column:
    """A document's default quality weight, 0.5 to 1.5: one half and its share of letters among non-space characters."""
    solid = text
    for space in " \t\n\x0b\x0c\r":
        solid = F.replace(solid, F.lit(space))
    solid = F.length(solid)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.when(solid > 0, F.lit(0.5) + letters / solid), F.lit(0.5))


def exponential_key(weight: Column, seed: int, *cols: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash; a weight that is null or not positive counts as 1e-9."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.when(weight > 0, weight).otherwise(F.lit(1e-9))


def cyclic_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, docs) with target: ``share`` of all sizes by cyclic weights, at most ``most`` times a source's size.

    Sources go by code point, null last. The excess of capped targets is reshared by weight among the
    others until none is above: that is filling to a common level, and a source is capped when the level
    passes its cap over its weight, so one pass in that order finds the level.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))).cast("int") + 1)
    t = sizes.withColumn("w", weight.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    t = t.withColumn("fill", F.col("cap") / F.col("w"))
    whole = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
    t = t.withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(order), F.lit(0.0)))
    above = F.col("fill") * F.col("w_left") > F.col("left")
    # the first source in that order whose cap lies above the level of what is left sets it
    t = t.withColumn("level", F.min_by(F.col("left") / F.col("w_left"), F.when(above, F.col("fill"))).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.col("fill")) * F.col("w"))
    return t.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))).select("source", "source_size", "docs", "target")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, store: Store | None = None) -> DataFrame:
    """Copies of each document in the mix.

    ``docs``: doc_id, source, size, weight and h (a hash that breaks ties), best a stored table, for it is
    read several times. ``targets``: source, docs (a count), source_size and target, which is at most a
    whole number of epochs and a remainder. Adds source_size, target, key, copies and taken (copies *
    size). Null sources are a source of their own. Documents of size 0 add nothing and are taken with
    their key.
    """
    store = store or Store(docs.sparkSession, "mixing")
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("s")
    bins = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(BIN_DOCS))).alias("bins")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.select(named, "source_size", "target", epochs.alias("epochs"), bins).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = store.put("plan", plan)
    key = exponential_key(F.col("weight"), seed, F.col("doc_id"), F.col("h"))
    spread = sum((1 - F.exp(-F.col("key") * F.lit(scale)) for scale in SCALES), F.lit(0.0))
    every = docs.withColumn("key", key).withColumn("s", named).join(plan, "s", "left").withColumn("bin", F.floor(spread * F.col("bins")))
    own = F.struct("key", "doc_id", "h")
    rows = every.select("s", "bin", "size", "rest", own.alias("own"))
    sums = rows.groupBy("s", "bin").agg(F.sum("size").alias("in_bin"), F.first("rest").alias("rest"))
    by_bin = Window.partitionBy("s").orderBy("bin")
    sums = sums.withColumn("before", F.sum("in_bin").over(by_bin) - F.col("in_bin"))
    cut_bin = sums.filter("before < rest and before + in_bin >= rest").groupBy("s").agg(F.min("bin").alias("cut_bin"), F.min_by("before", "bin").alias("before"))
    cut_bin = store.put("cut_bin", cut_bin)
    inside = store.put("inside", rows.join(cut_bin, "s").filter("bin = cut_bin").select("s", "own", "size", "rest", "cut_bin", "before"))
    order = Window.partitionBy("s").orderBy("own").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(order))
    below = inside.filter("upto <= rest").groupBy("s").agg(F.max("own").alias("cut"), F.max("upto").alias("upto"))
    cut = cut_bin.join(below, "s", "left").select("s", "cut_bin", "cut", F.coalesce("upto", "before").alias("met"))
    last = inside.filter("upto > rest").select("s", "own", "size", "rest").join(cut.select("s", "met"), "s").withColumn("gap", F.col("rest") - F.col("met"))
    last = last.filter("abs(size - gap) < gap").groupBy("s").agg(F.min_by("own", F.struct(F.abs(F.col("size") - F.col("gap")), "own")).alias("last"))
    edge = store.put("edge", cut.drop("met").join(last, "s", "left"))
    store.keep_only("rows", "plan", "edge")
    out = every.join(edge, "s", "left")
    inside_cut = F.coalesce(own <= F.col("cut"), F.lit(False)) | F.coalesce(own == F.col("last"), F.lit(False))
    taken = (F.col("rest") > 0) & ((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & inside_cut))
    out = out.withColumn("copies", F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("s", "bin", "bins", "cut", "last", "cut_bin", "epochs", "rest")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, weight: Column | None = None, carry: bool = False) -> DataFrame:
    """Mixes ``docs`` (doc_id, text, source): doc_id, source, size, weight, h, source_size, target, key, copies, taken.

    Null text has size 0; null doc_ids and repeated rows are documents of their own (equal ones are taken
    together); an empty table gives an empty result. ``weight`` is a column of ``docs``, and ``text_weight``
    where it is not given. h (a hash of the text) and doc_id name a row. With ``carry``, the columns of ``docs`` stay as the struct ``row``.
    """
    store = Store(docs.sparkSession, "mixing")
    row = [F.struct(*map(F.col, docs.columns)).alias("row")] if carry else []
    text = F.col("text")
    own = text_weight(text) if weight is None else weight.cast("double")
    rows = store.put("rows", docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), own.alias("weight"), F.xxhash64(text).alias("h"), *row))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = store.put("targets", cyclic_targets(sizes, weights, share, most))
    return mix(rows, targets, seed, store)


def expand(mixed: DataFrame) -> DataFrame:
    """The rows of a mix with ``carry``, each as often as it is taken."""
    return mixed.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
