"""Secret scans through a trigram index, wholly as DataFrame expressions.

Each rule's regular expression is turned into a Boolean query of trigrams that every match must
contain (on text with A-Z lower-cased): literals give conjunctions, alternatives disjunctions, and what
can be empty or is wider than a small class gives nothing. The index knows no rules: every trigram of
every text (three bytes of its lower-cased UTF-8) falls into one of ``BUCKETS`` buckets, and a posting
holds, for a bucket and a run of 64 rows, the bits of the rows with it. Rows are numbered where they
are read, so a run lies in one task and its bits are joined there before anything is shuffled. The index
is a table sorted by bucket, of which a scan reads the buckets that its rules name; all rules are then
answered at once, word by word, with bitwise operations. The rows left are a rule's candidates, and only
they run its regular expression; buckets that trigrams share add candidates but lose none. Rules without
mandatory trigrams run over all documents.

Positions are code points: the parts between matches (``split``) and the matches
(``regexp_extract_all``) take turns, so running sums of their lengths give every start and end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import Store


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` that also fit ``keep`` (a pattern for the whole match).

    ``guard`` is found in every text with a kept match; where a rule has no mandatory trigram, texts
    without it are passed over after a full scan for it.
    """

    kind: str
    pattern: str
    keep: str | None = None
    guard: str | None = None


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
#: In the order in which kinds that start together are listed.
BASE_RULES = (
    Rule("assign", rf"(?:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", r"[\s\S]*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}"),
    Rule("access", "AKIA[A-Z0-9]+", ".{16,}"),
    Rule("hex", "[0-9a-f]+", ".{32,}", "[0-9a-f]{32}"),
)
#: Kinds that the scan adds to the base ones.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("basic", r"[a-z]+://[^\s:/@]+:[^\s:/@]{3,}@[A-Za-z0-9.-]+"),
)

# Trigram queries: None is "any document"; a str is a trigram; ("and", parts) and ("or", parts).


def _conj(parts):
    parts = frozenset().union(*(_needs(p) for p in parts if p is not None))
    return None if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _needs(query) -> frozenset:
    return query[1] if isinstance(query, tuple) and query[0] == "and" else frozenset([query])


def _disj(parts):
    parts = set(parts)
    if None in parts or not parts:
        return None
    least = {p for p in parts if not any(_needs(q) < _needs(p) for q in parts)}  # what implies another part adds nothing
    return next(iter(least)) if len(least) == 1 else ("or", frozenset(least))


def _grams(s: str):
    return _conj(s[i : i + 3] for i in range(len(s) - 2))


MOST_STRINGS = 24


def _strings_of_class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower() if arg < 128 else chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MOST_STRINGS:
            out.update(chr(c).lower() if c < 128 else chr(c) for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(tree):
    """(strings the part is exactly one of, or None; query that every match meets).

    Runs of parts with known strings grow by products until there are too many of them; then the run's
    trigrams are secured and it starts anew.
    """
    run: set[str] | None = {""}
    secured = []
    exact = True
    for op, arg in tree:
        strings, query = None, None
        if op is sre.LITERAL:
            strings = {chr(arg).lower() if arg < 128 else chr(arg)}
        elif op is sre.IN:
            strings = _strings_of_class(arg)
        elif op is sre.SUBPATTERN:
            strings, query = _analyse(arg[3])
        elif op is sre.BRANCH:
            branches = [_analyse(b) for b in arg[1]]
            if all(s is not None for s, _ in branches):
                strings = set().union(*(s for s, _ in branches))
                strings = strings if len(strings) <= MOST_STRINGS else None
            query = _disj(q if s is None else _disj(map(_grams, s)) for s, q in branches)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = arg
            inner_strings, inner_query = _analyse(inner)
            if (low, high) == (0, 1) and inner_strings is not None:
                strings = {""} | inner_strings
            elif low == high == 1:
                strings, query = inner_strings, inner_query
            elif low >= 1:
                query = inner_query if inner_strings is None else _disj(map(_grams, inner_strings))
        elif op is sre.AT:
            strings = {""}
        grown = None if strings is None or run is None else {a + b for a in run for b in strings}
        if grown is not None and len(grown) <= MOST_STRINGS:
            run = grown
            continue
        exact = False
        secured.append(_disj(map(_grams, run)) if run else None)
        secured.append(query)
        run = strings if strings is not None else {""}
    tail = _disj(map(_grams, run)) if run else None
    return (run if exact else None), _conj([*secured, tail])


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; None where it has no mandatory trigram."""
    return _analyse(sre_parser.parse(pattern))[1]


def trigrams_in(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


BUCKETS = 8192
PIECE = 4096  # bytes of a text that are cut into trigrams together
RUN = 64  # rows whose bits share a long
#: Candidates are broadcast up to this number of bytes and dealt by run beyond it.
BROADCAST = 32 << 20


def bucket_of(trigram: Column) -> Column:
    return F.pmod(F.hash(trigram), F.lit(BUCKETS))


def build_index(rows: DataFrame) -> DataFrame:
    """(bucket, run, bits) of ``rows`` (slot, text): bit slot % 64 of run slot / 64 is set where the text has a trigram of the bucket."""
    raw = rows.select("slot", F.lower("text").cast("binary").alias("raw")).filter(F.octet_length("raw") >= 3)
    cuts = F.sequence(F.lit(0), F.expr(f"cast((octet_length(raw) - 3) div {PIECE} as int)"))
    pieces = raw.select("slot", F.explode(F.transform(cuts, lambda c: F.substring(F.col("raw"), c * PIECE + 1, F.lit(PIECE + 2)))).alias("piece"))
    grams = pieces.select("slot", "piece", F.explode(F.sequence(F.lit(1), F.octet_length("piece") - 2)).alias("i"))
    hits = grams.groupBy(bucket_of(F.substring("piece", F.col("i"), F.lit(3))).alias("bucket"), F.expr(f"slot div {RUN}").alias("run"))
    return hits.agg(F.expr(f"bit_or(shiftleft(1L, cast(slot % {RUN} as int)))").alias("bits"))


def answer(query, postings: Column) -> Column:
    """The bits of a run that meet a query, from its map of bucket to bits."""
    if isinstance(query, str):
        return F.coalesce(postings[bucket_of(F.lit(query).cast("binary"))], F.lit(0).cast("long"))
    parts = [answer(q, postings) for q in sorted(query[1], key=repr)]
    return reduce(Column.bitwiseAND if query[0] == "and" else Column.bitwiseOR, parts)


def candidates(index: DataFrame, queries: list) -> DataFrame:
    """(run, masks): for every run with a candidate, the bits that meet each query; no bits for queries that are None."""
    named = sorted(set().union(*map(trigrams_in, queries)))
    wanted = index.filter(F.col("bucket").isin(*[bucket_of(F.lit(t).cast("binary")) for t in named]))
    runs = wanted.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("postings"))
    masks = [F.lit(0).cast("long") if q is None else answer(q, F.col("postings")) for q in queries]
    return runs.select("run", F.array(*masks).alias("masks")).filter(F.exists("masks", lambda x: x != 0))


_SPANS = "array<struct<s:int,k:int,e:int>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, order, end) of a rule's leftmost non-overlapping matches that ``keep`` lets pass, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast(_SPANS)

    def step(acc, pair):
        s = acc["at"] + F.length(pair["gap"])
        e = s + F.length(pair["match"])
        ok = pair["match"].rlike(f"^(?:{rule.keep})$") if rule.keep else F.lit(True)
        own = F.array(F.struct(s.alias("s"), F.lit(order).alias("k"), e.alias("e"))).cast(_SPANS)
        return F.struct(e.alias("at"), F.when(ok, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def _listed(found: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Adds found_spans, an array of (s, k, e), sorted, k being the rule's number, to ``docs`` (text, ...).

    Null text is empty. Rows need no id: they are numbered in a copy in the shared folder, which the
    index and the scan read. An empty table gives an empty result. A column named found_spans is
    replaced; all others stay.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    base = docs.drop("found_spans")
    store = Store(docs.sparkSession, "secrets")
    rows = store.put("rows", base.select(F.monotonically_increasing_id().alias("slot"), F.struct(*map(F.col, base.columns)).alias("row")))
    text = F.col("row.text")
    if any(q is not None for q in queries):
        index = store.put("index", build_index(rows.select("slot", "row.text")).sortWithinPartitions("bucket", "run"))
        found = store.put("candidates", candidates(index, queries))
        store.drop("index")
        if found.count() * (8 * len(rules) + 32) <= BROADCAST:
            found = F.broadcast(found)
        rows = rows.join(found, F.expr(f"slot div {RUN}") == F.col("run"), "left")
    else:
        rows = rows.withColumn("masks", F.lit(None).cast("array<long>"))
    parts = []
    for i, (rule, q) in enumerate(zip(rules, queries, strict=True)):
        if q is not None:
            runs = F.coalesce(F.getbit(F.col("masks")[i], F.expr(f"cast(slot % {RUN} as int)")), F.lit(0)) == 1
        else:
            runs = text.rlike(rule.guard) if rule.guard else F.lit(True)
        parts.append(F.when(runs & text.isNotNull(), spans(text, rule, i)).otherwise(F.array().cast(_SPANS)))
    return rows.select("row.*", F.array_sort(F.concat(*parts)).alias("found_spans"))


def summarise(found: DataFrame, base: int = len(BASE_RULES), rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """n_<kind> of the first ``base`` rules, base_sha256 and spans, from found_spans."""
    kinds = [r.kind for r in rules]
    col = F.col("found_spans")

    def count(i: int) -> Column:
        return F.size(F.filter(col, lambda x: x["k"] == i)).cast("long").alias(f"n_{kinds[i]}")

    counts = [count(i) for i in range(base)]
    own = F.filter(col, lambda x: x["k"] < base)
    return found.select("doc_id", *counts, F.sha2(_listed(own, kinds), 256).alias("base_sha256"), _listed(col, kinds).alias("spans"))


def redact(found: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Replaces every span of found_spans in ``text`` by <kind>; of overlapping spans the first names the rest. Drops found_spans."""
    kinds = F.array(*[F.lit(f"<{r.kind}>") for r in rules])
    text = F.col("text")

    def step(acc, x):
        ahead = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(kinds, x["k"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], ahead).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("found_spans", start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return found.withColumn("text", F.when(F.size("found_spans") > 0, clean).otherwise(text)).drop("found_spans")
