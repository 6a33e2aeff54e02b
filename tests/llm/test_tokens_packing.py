import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import packing, token_store
from tidemark.llm._tokens import encoder


def _ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def _crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_the_library():
    rng = np.random.default_rng(0)
    parts = ["a", "B", "é", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'re", "9", "²", "ª", "_", "!!", "中", "“", "🙂", "ı", "́", "<|endoftext|>", "x" * 60, "\x00"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 30))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder().encode(texts)] == _ids(texts)


@pytest.mark.parametrize("vocab", [2, 3, 257, 50257, 65537, 1 << 20])
def test_bit_packing_round_trip(vocab):
    ids = np.random.default_rng(vocab).integers(0, vocab, 10_001).astype(np.uint32)
    raw = token_store.write_image(ids, [1, 10_000], vocab)
    image = token_store.Image(raw)
    assert image.width == max(1, (vocab - 1).bit_length())
    assert len(raw) <= 10_001 * image.width / 8 + 8 * 8 + 64
    for a, b in ((0, 10_001), (0, 0), (4095, 4097), (9_000, 10_001), (17, 18)):
        assert image.ids(a, b).tolist() == ids[a:b].tolist()


def test_token_files(spark, odd_docs):
    got = token_store.read_tokens(token_store.write_tokens(odd_docs, image_ids=500)).collect()
    named = odd_docs.selectExpr("doc_id", "xxhash64(text) as h", "text").collect()
    rows = [(r.doc_id, r.text) for r in sorted(named, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    start, want = 0, []
    for (doc_id, _), ids in zip(rows, _ids([t for _, t in rows]), strict=True):
        want.append((doc_id, start, len(ids) + 1, _crc([*ids, 0])))
        start += len(ids) + 1
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.read_tokens(token_store.write_tokens(odd_docs.limit(0))).collect() == []


def test_files_in_a_given_folder(spark, odd_docs, tmp_path):
    files = token_store.write_tokens(odd_docs, folder=f"file://{tmp_path}").collect()
    images = [token_store.Image((tmp_path / f.path.rsplit("/", 1)[1]).read_bytes()) for f in files]
    assert sorted(f.name for f in tmp_path.iterdir()) == sorted(f.path.rsplit("/", 1)[1] for f in files)
    assert sum(i.n_ids for i in images) == sum(len(x) + 1 for x in _ids([r.text for r in odd_docs.collect()]))
    assert sorted(str(d) for i in images for d in i.docs) == sorted(str(r.doc_id) for r in odd_docs.collect())


def test_one_hot_id_is_dealt_out(spark, words):
    docs = spark.createDataFrame([(None, " ".join(words(50, i))) for i in range(800)], "doc_id long, text string").repartition(8)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert len({f.part for f in token_store.write_tokens(docs).collect()}) > 1
    finally:
        spark.conf.unset(key)


def _naive(lengths, limits):
    cap, bins = limits.capacity(), []
    for n in sorted(lengths, reverse=True):
        need, best = (n, 1, n * n), None
        for i, left in enumerate(bins):
            if all(a >= b for a, b in zip(left, need, strict=True)):
                if limits.rule == "norm":
                    s = sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(limits.weights, left, need, cap, strict=True))
                else:
                    s = -sum(w * (b / c) * (a / c) for w, a, b, c in zip(limits.weights, left, need, cap, strict=True))
                if best is None or s < best[0]:
                    best = (s, i)
        if best is None:
            bins.append(cap)
            best = (0, len(bins) - 1)
        bins[best[1]] = tuple(a - b for a, b in zip(bins[best[1]], need, strict=True))
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limit", [{}, {"documents": 3, "attention": 400_000}])
def test_plan_equals_one_by_one_packing(rule, limit):
    limits = packing.Limits(rule=rule, **limit)
    lengths = np.minimum(np.random.default_rng(1).integers(1, 1025, 900), 600 if limit else 1024)
    values, counts = np.unique(lengths, return_counts=True)
    groups = packing.plan_bins(dict(zip(values.tolist(), counts.tolist(), strict=True)), limits)
    assert sum(g.count for g in groups) == _naive(lengths.tolist(), limits)
    table, bins = packing.plan_table(groups), {}
    for n, count in zip(values.tolist(), counts.tolist(), strict=True):
        for s, o in zip(*packing.place(table[n], n, np.arange(count)), strict=True):
            bins.setdefault(s, []).append((o, n))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces]]).tolist()[:-1]
        assert sum(n for _, n in pieces) <= 1024 and len(pieces) <= (limit.get("documents") or 1024)
        assert sum(n * n for _, n in pieces) <= (limit.get("attention") or 1024**2)


def test_pack(spark, odd_docs):
    got = packing.pack(odd_docs).collect()
    want = []
    for r, ids in zip(odd_docs.collect(), _ids([r.text for r in odd_docs.collect()]), strict=True):
        ids, start = [*ids, 2], 0
        for piece, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            want.append((str(r.doc_id), piece, start, n, _crc(ids[start : start + n])))
            start += n
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for v in places.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 1024
    assert packing.pack(odd_docs.limit(0)).collect() == []


@pytest.mark.parametrize("rule", ["best", "norm", "dot"])
def test_pack_under_binding_limits(spark, odd_docs, rule):
    limits = packing.Limits(tokens=64, documents=3, attention=64 * 64, rule=rule)
    places = {}
    for r in packing.pack(odd_docs, limits).collect():
        places.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(v) <= 64 and len(v) <= 3 and sum(n * n for n in v) <= 64 * 64 for v in places.values())
    assert any(len(v) == 3 and sum(v) < 60 for v in places.values()) and sum(map(sum, places.values())) == sum(len(x) + 1 for x in _ids([r.text for r in odd_docs.collect()]))


def test_encoder_with_a_full_cache(monkeypatch):
    from tidemark.llm import _tokens

    monkeypatch.setattr(_tokens, "CACHE_PIECES", 50)
    own = _tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"piece{(i * j) % 90} word{j % 30}" for j in range(60)) for i in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() for s in range(0, 40, 4) for x in own.encode(texts[s : s + 4])] == _ids(texts)
    assert len(own.cache) <= 50 + 2 * 240 and not own.cache.old or own.cache.old.old == {}
