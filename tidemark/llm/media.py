"""Media columns: interleaved text and media sequences, and a content-addressed media store.

Media are 8-bit grayscale images of 64 samples a row in a small lossless container:

    magic "TMG8", coding (one byte, 0: deflate), rows (uint32), then the coded samples; integers are little-endian

The store is a Parquet table keyed by the SHA-256 of the stored form, in the shared folder. Pages are
parsed into an ordered array of text and media-reference structs with position and caption; references
name digests, so payloads (or what was computed from them) join by digest, a small key, and every
element keeps its place. Hot digests are one row of the store; joins carry no payload unless asked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._store import Store
from tidemark.llm._words import slices, texts_of

ROW = 64
HEAD = struct.Struct("<4sBI")
MAGIC = b"TMG8"
SCHEME = "digest:"
ITEM = T.ArrayType(T.StructType().add("position", "integer").add("kind", "string").add("text", "string").add("ref", "string").add("caption", "string"))
ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def pad(raw: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def encode_image(samples: bytes) -> bytes:
    """The stored form of whole rows of samples."""
    plain = zlib.compress(samples, 1)
    return HEAD.pack(MAGIC, 0, len(samples) // ROW) + plain


def decode_image(stored: bytes) -> bytes:
    magic, kind, rows = HEAD.unpack_from(stored)
    if magic != MAGIC or kind != 0:
        raise ValueError("not a stored image")
    out = zlib.decompress(stored[HEAD.size :])
    if len(out) != rows * ROW:
        raise ValueError("samples are missing")
    return out


def image_features(samples: bytes) -> str:
    """Mean and deviation of the samples, share of zeros, and a 64-bit difference hash of the column means."""
    a = np.frombuffer(samples, dtype=np.uint8).reshape(-1, ROW)
    columns = a.mean(axis=0, dtype=np.float64)
    bits = columns > np.roll(columns, -1)
    return f"rows={len(a)};mean={a.mean():.4f};std={a.std():.4f};zeros={float((a == 0).mean()):.4f};dhash={np.packbits(bits).tobytes().hex()}"


class _Sequence(HTMLParser):
    """Ordered text and media items of a page; text of script, style and head parts is left out."""

    HIDDEN = frozenset(("script", "style", "noscript", "template", "title"))
    IN_HEAD = HIDDEN | {"head", "html", "meta", "link", "base"}
    BREAKS = frozenset(("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "figure", "figcaption", "blockquote", "pre", "td", "ul", "ol", "table", "nav", "header", "footer", "main", "aside", "body"))
    MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}

    def __init__(self, shown: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.shown = shown
        self.items: list[dict] = []
        self.words: list[str] = []
        self.head = False
        self.hidden: list[str] = []
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def leave_head(self) -> None:
        self.head, self.hidden = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif self.head and tag not in self.IN_HEAD:  # the end tag of the head may be left out
            self.leave_head()
        if tag in self.HIDDEN and tag not in self.shown:
            self.hidden.append(tag)
        if tag in self.BREAKS or tag in self.MEDIA:
            if self.caption is None:
                self.flush()
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.MEDIA:
            at = dict(attrs)
            if at.get("src") or at.get("data-src"):
                caption = " ".join((at.get("alt") or at.get("title") or "").split()) or None
                self.items.append({"kind": self.MEDIA[tag], "text": None, "ref": at.get("src") or at.get("data-src"), "caption": caption})

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        if tag == "head":
            self.leave_head()
        if tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            own = [x for x in self.items[self.figures[-1] if self.figures else 0 :] if x["kind"] != "text"]
            if own and said:
                for x in own if self.figures else own[-1:]:
                    x["caption"] = said
            elif said:
                self.words.append(said)
        elif tag == "figure" and self.figures:
            self.figures.pop()
        if tag in self.BREAKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            if self.head and data.strip():
                self.leave_head()
            self.words.append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Items in document order, each with its position; null and empty pages have none.

    A part that hides its text but never ends hides nothing: the page is read again with it shown.
    """
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    if parser.hidden:
        parser = _Sequence(frozenset(parser.hidden))
        parser.feed(html or "")
        parser.close()
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.items)]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``items`` to ``pages``: the ordered array of (position, kind, text, ref, caption)."""
    base = pages.drop("items")
    keep = base.columns
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_ = batch.column(html).to_pylist()
            for a, b in slices(len(p or "") for p in pages_):
                items = pa.array([parse_sequence(p) for p in pages_[a:b]], type=ITEMS)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, items], [*keep, "items"])

    schema = T.StructType(list(base.schema)).add("items", ITEM)
    return base.mapInArrow(run, schema)


def resolve(sequences: DataFrame, key: list[str], media: DataFrame, digest: str = "media_sha256") -> DataFrame:
    """Items of ``sequences`` in rows (key columns, position, kind, text, caption, digest) with the columns of ``media``.

    References of the form ``digest:<hex>`` join ``media`` on its ``digest`` column, of which there is one
    row a digest; other references and those without a payload keep their place with nulls. Items
    without a digest (all text) are dealt out by a hash of their own, not to the one null.
    """
    rows = sequences.select(*key, F.explode("items").alias("x")).select(*key, "x.position", "x.kind", "x.text", "x.caption", "x.ref")
    rows = rows.withColumn(digest, F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64)))
    at = F.coalesce(digest, F.concat(F.lit("-"), F.xxhash64(*key, "position", "text").cast("string")))
    return rows.withColumn("_at", at).join(media.withColumnRenamed(digest, "_at"), "_at", "left").drop("_at")


def stored_texts(texts: list[bytes]) -> list[tuple[str, bytes, str, bytes]]:
    """Of each text: digest and stored form of its padded bytes as an image, and of the last row of it."""
    out = []
    for t in texts:
        samples = pad(t)
        whole, tail = encode_image(samples), encode_image(samples[-ROW:])
        out.append((hashlib.sha256(whole).hexdigest(), whole, hashlib.sha256(tail).hexdigest(), tail))
    return out


def page_of(text: bytes, whole: str, tail: str) -> str:
    """A page of the text's lines as paragraphs, its image as a figure after the first half of them, and the image of its last row at the end."""
    lines = [f"<p>{escape(x, quote=False)}</p>" for x in text.decode().split("\n") if x.strip()]
    lines.insert((len(lines) + 1) // 2, f'<figure><img src="{SCHEME}{whole}"><figcaption>{len(text)} bytes</figcaption></figure>')
    return f'<html><head><title>{len(text)}</title><body>{"".join(lines)}<img src="{SCHEME}{tail}" alt="last row">'


def store_texts(docs: DataFrame, store: Store) -> DataFrame:
    """Writes the UTF-8 bytes of ``docs`` (text), padded, as images, and the last row of each; returns the table (media_sha256, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(map(len, texts)):
                made = stored_texts(texts[a:b])
                digests, media = [x for m in made for x in (m[0], m[2])], [x for m in made for x in (m[1], m[3])]
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], ["media_sha256", "media"])

    return store.put("media", docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "media_sha256 string, media binary"))


def text_sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, items) of ``docs`` (doc_id, text): the parsed pages of ``page_of``. Null text is empty and has its two images alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(map(len, texts)):
                items = [parse_sequence(page_of(t, m[0], m[2])) for t, m in zip(texts[a:b], stored_texts(texts[a:b]), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(items, type=ITEMS)], ["doc_id", "n_bytes", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType().add("doc_id", "long").add("n_bytes", "long").add("items", ITEM))


def read_back(media: DataFrame) -> DataFrame:
    """Per digest, from the stored bytes: media_bytes, payload_bytes, payload_sha256, tail_crc32 and feature."""
    names = ("media_sha256", "media_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stored in batch.column("media"):
                raw = stored.as_py()
                samples = decode_image(raw)
                out.append((hashlib.sha256(raw).hexdigest(), len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), image_features(samples)))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    seen = media.select("media").mapInArrow(run, "media_sha256 string, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    return seen.dropDuplicates(["media_sha256"])


def document_media(docs: DataFrame) -> DataFrame:
    """Stores every text as images, parses the page that interleaves its lines with them, and joins what was read back of the whole text's image by digest.

    One row per row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, position and caption of the image in its page, n_items of the page. Null
    ids stay null; rows repeated with one id are rows of their own; an empty table gives an empty result.
    """
    store = Store(docs.sparkSession, "media")
    media = store_texts(docs, store)
    whole = F.filter("items", lambda x: (x["kind"] == "image") & x["caption"].endswith(" bytes"))
    sequences = text_sequences(docs).select("doc_id", "n_bytes", F.size("items").alias("n_items"), whole.alias("items"))
    items = resolve(sequences, ["doc_id", "n_bytes", "n_items"], read_back(media))
    return items.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")
