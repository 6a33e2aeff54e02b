"""Token ids by a public tokenizer file, with a bounded cache of encoded pieces.

A byte-level tokenizer cuts a text into pieces (a word with the space before it, a run of digits, of
signs, of white space) and merges never cross pieces, so a text's ids are the joined ids of its pieces.
Pieces repeat far more often than texts; each distinct one goes through the library's model once while
it is cached. Texts in Latin-1 are cut here by the same pattern with its character classes spelled out,
which for that range are the same in every Unicode version; others are first cut at single spaces
between non-space characters, always a boundary, and what is not Latin-1 then goes through the whole
tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT_FILE = "byte_bpe_50k.json"
#: Pieces in each of the two generations of a worker's cache, and the longest that is cached.
CACHE_PIECES = 500_000
CACHED_CHARS = 40
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LETTER, _DIGIT, _WHITE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_WHITE}{_LETTER}{_DIGIT}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_encoders: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Cache(dict):
    """Ids of pieces, made where they are missing; a piece of the generation before (``old``) is not made again."""

    def __init__(self, make, old: Cache | None = None):
        super().__init__()
        self.make, self.old = make, {} if old is None else old
        if old is not None:
            old.old = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = (
            spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and not spec["model"].get("dropout")
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        )
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        if self.pieces and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # its own cache only costs time behind this one
        self.model = self.tokenizer.model
        self.cache = Cache(self._piece)

    def _whole(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # of these only the space has another stand-in
            letters = piece.replace(" ", self.letters[0x20])
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.pieces:
            return self._whole(texts)
        cut: list[tuple[list[str], bool]] = []  # pieces of a text, and whether some are chunks for the whole tokenizer
        other: dict[str, bytes] = {}
        for t in texts:
            if any(s in t for s in self.specials):
                cut.append(([t], True))
                other[t] = b""
            elif _latin(t):
                cut.append((_PIECE.findall(t), False))
            else:
                chunks = _CUT.split(t)
                chunks[1:] = [" " + c for c in chunks[1:]]
                parts = []
                for c in chunks:
                    if _latin(c):
                        parts += _PIECE.findall(c)
                    else:
                        parts.append(c)
                        other[c] = b""
                cut.append((parts, True))
        if other:
            names = list(other)
            other = dict(zip(names, self._whole(names), strict=True))
        ids_of = self.cache.__getitem__
        out = [b"".join([other[p] if p in other else ids_of(p) for p in parts] if mixed else map(ids_of, parts)) for parts, mixed in cut]
        if len(self.cache) > CACHE_PIECES:
            self.cache = Cache(self._piece, self.cache)
        return out


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder of this file; ``path`` defaults to the public byte-level BPE of 50,257 ids."""
    path = path or public_tokenizers.path(DEFAULT_FILE)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF
