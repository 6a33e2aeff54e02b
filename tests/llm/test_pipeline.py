import brute
import corpus_pipeline as pipeline


def test_stages_on_planted_rows(spark, words, tmp_path):
    docs, labels = [], []
    for i in range(400):
        w = words(60, i)
        if i % 5 == 0:
            w[3], w[30] = "vilewordone", "vilewordtwo"
        docs.append((i, " ".join(w) + ".", "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + i, docs[i][1], "en", "s1", 0) for i in range(1, 5)] + [(2000, "token=abcdefgh12 " + " ".join(words(50, 5000)), "en", "s2", 0), (None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = rows
        if name != "packing":
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {d[0] for d in docs if d[0] is None or not (d[0] < 400 and d[0] % 5 == 0)}
    assert {r.doc_id for r in seen["toxicity"].collect()} == clean
    kept = brute.near_dups([(d[0], d[1]) for d in docs if d[0] is not None and d[0] in clean], 5)
    assert {r.doc_id for r in seen["near_dedup"].collect() if r.doc_id is not None} == {k[0] for k in kept if k[3]}
    texts = {r.doc_id: r for r in seen["secrets"].collect()}
    assert texts[2000].text.startswith("<assign> ") and texts[2000].n_chars == len(texts[2000].text)
    assert {r.doc_id for r in seen["mixing"].collect()} <= set(texts)
    assert seen["packing"].filter("piece = 0").count() == seen["mixing"].count()
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in seen["packing"].collect()}
