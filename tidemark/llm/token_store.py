"""Token ids in files of fixed-width bit packing.

A file holds whole documents in ascending doc_id order:

    magic "TMBP2\\0", width in bits (uint16), block length in ids (uint32), ids (uint64), documents (uint32)
    block offsets in bytes within the payload (uint64 each, one past the last at the end)
    per document: ids (uint64); per document: doc_id (int64); per document: 1 if its id is null (one byte)
    payload: per block, ids of ``width`` bits each, most significant bit first, padded to whole bytes

``width`` is the least that holds the vocabulary. Block offsets give random access: a range of ids
touches only its blocks, and a block unpacks as one numpy operation. All integers are little-endian.

Files are written by the tasks into a folder that all executors see (any file system that pyarrow opens
by its URI), each under a name of its own and then moved into place, so that a task that is run again
puts the same bytes there; the manifest, a table with one row a file, names those of finished tasks.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import Store
from tidemark.llm._tokens import crc, encoder
from tidemark.llm._words import slices

MAGIC = b"TMBP2\0"
HEAD = struct.Struct("<6sHIQI")
BLOCK_IDS = 4096
IMAGE_IDS = 1 << 20

FILE_SCHEMA = "part int, seq long, first_id long, n_ids long, path string, bytes long"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width_of(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_block(ids: np.ndarray, width: int) -> bytes:
    """ids as ``width``-bit integers, most significant bit first."""
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = (ids[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint32)[None, :]) & 1
    return np.packbits(bits.astype(bool).ravel()).tobytes()


def unpack_block(raw: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(raw, dtype=">u2", count=n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * width).reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width - 1, -1, -1, dtype=np.uint32))


def write_image(ids: np.ndarray, sizes: list[int], vocab_size: int, docs: list[int | None] | None = None) -> bytes:
    """The bytes of a file of documents whose ids follow one another; without ``docs`` their names are null."""
    width = width_of(vocab_size)
    names = docs if docs is not None else [None] * len(sizes)
    blocks = [pack_block(ids[i : i + BLOCK_IDS], width) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    own = [np.array(sizes, dtype="<u8"), np.array([d or 0 for d in names], dtype="<i8"), np.array([d is None for d in names], dtype=np.uint8)]
    return b"".join([HEAD.pack(MAGIC, width, BLOCK_IDS, len(ids), len(sizes)), offsets.tobytes(), *(x.tobytes() for x in own), *blocks])


class Image:
    """Reads a file's bytes; ``ids(a, b)`` unpacks only the blocks that the range touches."""

    def __init__(self, raw: bytes):
        magic, self.width, self.block, self.n_ids, n_docs = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        n_blocks, at = -(-self.n_ids // self.block), HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.offsets, self.sizes, ids, null = take("<u8", n_blocks + 1), take("<u8", n_docs), take("<i8", n_docs), take("u1", n_docs)
        self.docs = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.payload = memoryview(raw)[at:]

    def ids(self, a: int, b: int) -> np.ndarray:
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError((a, b, self.n_ids))
        if a == b:
            return np.zeros(0, dtype="<u4")
        low, high = a // self.block, (b - 1) // self.block
        out = []
        for k in range(low, high + 1):
            n = min(self.block, self.n_ids - k * self.block)
            out.append(unpack_block(self.payload[int(self.offsets[k]) : int(self.offsets[k + 1])], n, self.width))
        return np.concatenate(out)[a - low * self.block : b - low * self.block].astype("<u4")


def _writer(folder: str, tokenizer: str | None, end_id: int, image_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        seq = first = held = 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        sizes: list[int] = []

        def put() -> pa.RecordBatch:
            nonlocal seq, first
            flat = np.concatenate(ids)
            raw = write_image(flat, sizes, enc.vocab_size, docs)
            name = f"tokens-{part:06d}-{seq:06d}.tmbp"
            own = f"{root}/{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as f:
                f.write(raw)
            try:
                system.move(own, f"{root}/{name}")
            except OSError:  # a file system that does not replace: the same bytes are there from an earlier run of the task
                if system.get_file_info(f"{root}/{name}").size != len(raw):
                    raise
                system.delete_file(own)
            row = [[part], [seq], [first], [len(flat)], [f"{folder}/{name}"], [len(raw)]]
            seq, first = seq + 1, first + len(flat)
            for x in (ids, docs, sizes):
                x.clear()
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in FILE_SCHEMA.split(", ")])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(map(len, texts)):
                for doc_id, raw in zip(names[a:b], enc.encode(texts[a:b]), strict=True):
                    own = np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id)).astype(np.uint32)
                    ids.append(own)
                    docs.append(doc_id)
                    sizes.append(len(own))
                    held += len(own)
                    if held >= image_ids:
                        yield put()
                        held = 0
        if ids:
            yield put()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: place, ids and checksum, unpacked from the files named by (path, start)."""
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as f:
                im = Image(f.read())
            flat = im.ids(0, im.n_ids).tobytes()
            ends = np.cumsum(im.sizes.astype(np.int64))
            starts = ends - im.sizes.astype(np.int64)
            sums = [crc(flat[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            cols = [pa.array(im.docs, pa.int64()), pa.array(starts + before), pa.array(ends - starts), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in ROW_SCHEMA.split(", ")])


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, image_ids: int = IMAGE_IDS, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as token files in ascending doc_id order and returns the manifest: part, seq, first_id, n_ids, path, bytes.

    Documents are dealt by ranges of doc_id, so parts and the files in them are in the order of ids; null
    ids come first, rows with equal ids in the order of a hash of their texts, so that a hot id is dealt out
    too. Null text is empty: it has the end id alone. ``first_id`` is a file's place within its part.
    ``folder`` is the URI of an existing folder, by default one in the shared folder.
    """
    store = Store(docs.sparkSession, "tokens")
    folder = folder or store.folder("files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    order = ("doc_id", "h", "n")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return store.put("manifest", rows.mapInArrow(_writer(folder, tokenizer, end_id, image_ids), FILE_SCHEMA))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, read from the files of a manifest: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the totals of the parts before, one row a part, to the place within the part.
    """
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    files = manifest.join(before, "part").select("path", (F.col("before") + F.col("first_id")).alias("start"))
    return files.repartition(max(1, manifest.count() // 2), "path").mapInArrow(_reader, ROW_SCHEMA)
