"""Line-first cleaning: rules per line, failed lines removed, then documents that lose too much rejected.

A line (split at \\n) fails if it is boilerplate (sentences with licence, rights and consent phrases hold
a third of its words or more, at any length), navigation
(cells separated by bars or the like, or shouting: every word upper-case or closed by "!!"), noisy
(a large share of symbols), or unpunctuated (12 words or more, and no sentence end or closing double
quote at its end).
Empty lines and repeated lines pass the line rules; copies count in the base features. A document is
kept if its base features pass and at most ``max_lost`` of its words stood in failed lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm._store import small_batches
from tidemark.llm._words import WHITE, Words, slices, texts_of

BOILERPLATE = re.compile(
    rb"all rights reserved|licensed under|is licensed|general public license|creative commons|terms of (?:use|service)|privacy policy|cookie|copyright|\xc2\xa9|subscribe|sign (?:in|up)|click here|javascript",
    re.I,
)
SEPARATORS = re.compile(rb" (?:[|>]|\xc2\xbb|\xc2\xb7) ")  # bar, angle, guillemet, middle dot
MARK = rb"(?:[.!?:;]|\xe2\x80\xa6|\xe3\x80\x82|\xef\xbc[\x81\x9a\x9b\x9f]|\xd8\x9f|\xe0\xa5\xa4)"
DOUBLE_QUOTE = rb"(?:\"|\xe2\x80\x9d|\xc2\xbb|\xe3\x80\x8d)"
CLOSING = rb"(?:[')\]]|\xe2\x80\x99|\xef\xbc\x89|" + DOUBLE_QUOTE + rb")"
LINE_END = re.compile(rb"(?:" + MARK + CLOSING + rb"*|" + DOUBLE_QUOTE + rb")$")
SENTENCE = re.compile(rb"(?<=[.!?;])\s+|(?<=\xe3\x80\x82)|(?<=\xef\xbc\x81)|(?<=\xef\xbc\x9f)")
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SYMBOL_BYTES = b"#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8


def line_fails(line: bytes) -> str:
    """The rule that a line fails, or "". The line has at least one word."""
    words = line.split()
    if BOILERPLATE.search(line):
        parts = [(BOILERPLATE.search(x), len(x.split())) for x in SENTENCE.split(line)]
        if 3 * sum(n for hit, n in parts if hit) >= sum(n for _, n in parts):
            return "boilerplate"
    bars = len(SEPARATORS.findall(line)) + line.endswith(b" |")
    if bars >= 2 and 3 * bars >= len(words) or bars == 1 and len(words) <= 3:
        return "navigation"
    if len(words) >= 3 and 2 * sum(w.endswith(b"!!") for w in words) > len(words):
        return "navigation"
    if len(words) >= 2 and 10 * (len(line) - len(line.translate(None, SYMBOL_BYTES))) > len(line):
        return "noise"
    if len(words) >= 12 and not LINE_END.search(line.rstrip()[-24:]):
        return "punctuation"
    return ""


def clean_lines(text: bytes) -> tuple[bytes, int, int]:
    """The text without failed lines, their number, and the words they held."""
    kept, failed, lost = [], 0, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n and line_fails(line):
            failed, lost = failed + 1, lost + n
        else:
            kept.append(line)
    return b"\n".join(kept), failed, lost


def base_features(texts: list[bytes]) -> np.ndarray:
    """Rows of FEATURES for a few texts."""
    w = Words(texts, fold=False)
    counts = w.counts()
    doc = np.repeat(np.arange(len(texts)), counts)
    buf = w.buf
    letter = ~WHITE[buf] & ((buf & 0xC0) != 0x80)  # first bytes of code points
    spans = np.concatenate(([0], np.cumsum(letter)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[buf])))
    chars = spans[w.base[1:]] - spans[w.base[:-1]]
    signs = symbols[w.base[1:]] - symbols[w.base[:-1]]
    dup = [_dup_lines(t) for t in texts]
    n = len(w.hash)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= WINDOW:
        grams = w.grams(WINDOW)
        at = np.flatnonzero(np.arange(n) + WINDOW <= w.first[1:][doc])
        order = at[np.lexsort((grams[at], doc[at]))]
        same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        starts = order[twice]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(covered[:n]) > 0)))
    repeats = hit[w.first[1:]] - hit[w.first[:-1]]
    return np.stack((counts, chars, signs, np.array(dup, dtype=np.int64), repeats), axis=1)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else []
    return len(lines) - len(set(lines))


def clean_documents(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_lines, n_lost_words, kept and cleaned to ``docs`` (with a column text).

    base_failed: under 20 words, or over 30% of them in repeated 8-word windows. ``cleaned`` is the text
    without failed lines. Null text counts as empty: it has no words, fails and is cleaned to "".
    Columns of these names are replaced; all others stay.
    """
    small_batches(docs.sparkSession)
    names = (*FEATURES, "base_failed", "n_failed_lines", "n_lost_words", "kept", "cleaned")
    base = docs.drop(*names)
    keep = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(map(len, texts), most=4096):
                f = base_features(texts[a:b])
                failed = (f[:, 0] < 20) | (100 * f[:, 4] > 30 * f[:, 0])
                lines = [clean_lines(t) for t in texts[a:b]]
                lost = np.array([x[2] for x in lines], dtype=np.int64)
                kept = ~failed & (lost <= max_lost * f[:, 0])
                cols = [pa.array(f[:, i]) for i in range(len(FEATURES))]
                cols += [pa.array(failed), pa.array([x[1] for x in lines], pa.int64()), pa.array(lost), pa.array(kept), pa.array([x[0].decode() for x in lines], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *cols], [*keep, *names])

    schema = T.StructType(list(base.schema))
    for name in names:
        schema = schema.add(name, {"base_failed": "boolean", "kept": "boolean", "cleaned": "string"}.get(name, "long"))
    return base.mapInArrow(run, schema)
