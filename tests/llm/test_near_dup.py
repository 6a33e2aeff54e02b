import brute
import numpy as np

from tidemark.llm.near_dup import SAMPLES, max_xor, near_duplicates, sketch_slice


def _rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def _edited(words, seed, share):
    rng = np.random.default_rng(seed)
    return [w if rng.random() > share else f"e{seed}x{i}" for i, w in enumerate(words)]


def test_matches_brute_force(spark, words):
    rows = [(i, " ".join(words(40 + i, i))) for i in range(60)]
    for g in range(6):  # chains and stars of near copies about the threshold
        text = words(200, 1000 + g)
        for j in range(12):
            rows.append((100 + 20 * g + j, " ".join(text)))
            text = _edited(text, 50 * g + j, 0.02 + 0.005 * g)
    rows += [(900 + i, " ".join(words(120, 77))) for i in range(5)] + [(950, "a b"), (951, "a  b"), (952, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k in (4, 5):
        assert _rows(near_duplicates(docs, k)) == brute.near_dups(rows, k)


def test_hot_group_is_whole(spark, words):
    base = words(150, 5)
    rows = [(i, " ".join(_edited(base, i, 0.03 if i % 3 else 0.01))) for i in range(400)]
    assert _rows(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)) == brute.near_dups(rows, 4)


def test_one_link_in_a_group_just_under_the_threshold(spark):
    shared = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(90):  # any two have a similarity of 397/501; 40 and 41 share three more words: 400/498
        own = [f"own{i}x{j}" for j in range(52)]
        rows.append((i, " ".join(shared + ([*"xyz", *own[3:]] if i in (40, 41) else own))))
    want = brute.near_dups(rows, 4)
    assert [r[0] for r in want if not r[3]] == [41]
    assert _rows(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)) == want


def test_odd_rows(spark, odd_docs):
    got = near_duplicates(odd_docs, 5).collect()
    assert len(got) == odd_docs.count()
    named = {(r.doc_id, r.n_shingles): r for r in got if r.doc_id is not None}
    assert {r.component_id for k, r in named.items() if k in ((1, 296), (2, 296), (3, 296))} == {1}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert named[5, 0].component_id == 5 and named[6, 0].kept and named[8, 1].n_shingles == 1


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 4).collect() == []


def test_sketches_estimate_similarity():
    apart = []
    for seed in range(40):
        rng = np.random.default_rng(seed)
        base = [b"w%d" % x for x in rng.integers(0, 10**9, 400)]
        other = base[44:] + [b"q%d" % x for x in rng.integers(0, 10**9, 44)]  # similarity 0.8
        s = sketch_slice([b" ".join(base), b" ".join(other)], 4)[4]
        apart.append(int(np.bitwise_count(s[0] ^ s[1]).sum()))
    assert max(apart) < max_xor(0.8)
    mean = 1024 * (1 - (1 - 2 / 2048) ** (2 * SAMPLES * 0.2))
    assert abs(np.mean(apart) - mean) < 12
