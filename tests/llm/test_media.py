import hashlib
import zlib

from tidemark.llm import media


def test_sequence_keeps_order_positions_and_captions():
    page = """<html><head><title>t</title><style>p{}</style></head><body><h1>Top &amp; more</h1><p>One <b>two</b></p>
    <figure><img src="digest:aa" alt="alt"><figcaption>Said <i>so</i></figcaption></figure><script>var x="<p>no</p>"</script><p>Three<img src="/b.png" alt=" second  one ">four</p><img></body></html>"""
    items = media.parse_sequence(page)
    assert [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in items] == [
        (0, "text", "Top & more", None), (1, "text", "One two", None), (2, "image", "digest:aa", "Said so"), (3, "text", "Three", None), (4, "image", "/b.png", "second one"), (5, "text", "four", None),
    ]
    assert media.parse_sequence(None) == media.parse_sequence("") == []


def test_tags_that_are_left_out_hide_nothing():
    def said(page):
        return [x["text"] or x["ref"] for x in media.parse_sequence(page)]

    assert said("<head><title>t</title><body><p>hello</p><img src='a'>") == ["hello", "a"]
    assert said("<html><head><meta charset='utf-8'><style>b{}</style>plain words<p>more") == ["plain words", "more"]
    assert said("<body><noscript><p>one</p><p>two") == ["one", "two"]
    assert said("<p>a</p><template><b>b</b><p>c") == ["a", "b", "c"]
    assert said("<p>a</p><template><b>b</b></template><noscript>n</noscript><p>c") == ["a", "c"]


def test_container_round_trip():
    for raw in (b"", b"a", b"x" * 64, bytes(range(256)) * 3 + b"q"):
        payload = media.pad(raw)
        assert len(payload) % 64 == 0 and payload.startswith(raw) and len(payload) >= 64
        assert media.decode_image(media.encode_image(payload)) == payload


def test_document_media(spark, odd_docs):
    got = sorted(media.document_media(odd_docs).collect(), key=lambda r: (str(r.doc_id), r.n_bytes))
    rows = sorted(((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()), key=lambda r: (str(r[0]), len(r[1])))
    assert len(got) == len(rows)
    for r, (doc_id, raw) in zip(got, rows, strict=True):
        p = media.pad(raw)
        lines = sum(bool(x.strip()) for x in raw.decode().split("\n"))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.position) == (doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), (lines + 1) // 2)
        assert (r.caption, r.n_items, r.feature) == (f"{len(raw)} bytes", lines + 2, media.image_features(p))
        stored = media.encode_image(p)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.document_media(odd_docs.limit(0)).collect() == []


def test_sequences_of_texts_resolve_every_reference(spark):
    text = "One & <two>\n\nthree\nfour five"
    docs = spark.createDataFrame([(1, text), (2, "four five"), (3, None)], "doc_id long, text string")
    rows = media.resolve(media.text_sequences(docs), ["doc_id"], media.read_back(media.store_texts(docs, media.Store(spark, "test")))).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position, r.kind, r.text, r.caption, r.payload_bytes) for r in rows] == [
        (1, 0, "text", "One & <two>", None, None), (1, 1, "text", "three", None, None), (1, 2, "image", None, f"{len(text)} bytes", 64), (1, 3, "text", "four five", None, None), (1, 4, "image", None, "last row", 64),
        (2, 0, "text", "four five", None, None), (2, 1, "image", None, "9 bytes", 64), (2, 2, "image", None, "last row", 64), (3, 0, "image", None, "0 bytes", 64), (3, 1, "image", None, "last row", 64),
    ]


def test_unresolved_references_keep_their_place(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="digest:no"><img src="digest:yes">', 3), (2, None, 4)], "page_id long, html string, items int")
    store = spark.createDataFrame([("yes", b"1")], "media_sha256 string, media binary")
    got = media.resolve(media.interleave(pages), ["page_id"], store).orderBy("position").collect()
    assert [(r.position, r.text, r.media) for r in got] == [(0, "a", None), (1, None, None), (2, None, b"1")]
