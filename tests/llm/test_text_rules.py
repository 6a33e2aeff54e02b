import brute
import numpy as np
import pytest

from tidemark.llm import importance, line_quality, mixing, secrets, suffix_dedup, toxicity


def _order(r):
    return (str(r[0]), *map(str, r[1:]))


def test_line_features(spark, odd_docs, words):
    extra = [" ".join(words(30, i) * (1 + i % 3)) + "\n#*$%&|<>\n" * (i % 4) for i in range(20)]
    docs = odd_docs.select("doc_id", "text", "label", "kept").union(spark.createDataFrame([(100 + i, t, 0, False) for i, t in enumerate(extra)], "doc_id long, text string, label int, kept boolean"))
    got = line_quality.clean_documents(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=_order) == sorted(((r.doc_id, *brute.line_base(r.text)) for r in docs.collect()), key=_order)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed) and r.label is not None
    assert line_quality.clean_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "line, rule",
    [
        (b"All rights reserved.", "boilerplate"), ("Home \u00bb News \u00bb About \u00bb Us".encode(), "navigation"), ("Home \u00b7 News \u00b7 About".encode(), "navigation"), (b"Home | News | About |", "navigation"), (b"BUY!! NOW!! HERE!! GO!!", "navigation"), (b"the&&& cat### sat***", "noise"),
        (b"word " * 12, "punctuation"), (b"A plain sentence about the sea.", ""), (b"Short title", ""),
    ],
)
def test_line_rules(line, rule):
    assert line_quality.line_fails(line) == rule


@pytest.mark.parametrize(
    "line, rule",
    [
        (b"men's shoes (new) women's shoes hats bags belts scarves gloves socks coats rings", "punctuation"), (b"One sentence. " + b"word " * 12, "punctuation"),
        (b'They said that this line of more than twelve words ends "like this."', ""), (b"word " * 12 + "\u5c3e\u3002 ".encode(), ""),
        (b"This work is licensed under the terms below, which hold for every copy. " * 8, "boilerplate"),
        ("\u6211\u4eec\u4f7f\u7528 cookie \u6765\u6539\u5584\u670d\u52a1\u3002".encode() * 20, "boilerplate"),
        (b"We ate a cookie by the sea. " + b"The waves were high that day, and nobody swam. " * 12, ""),
    ],
)
def test_line_ends_and_long_lines(line, rule):
    assert line_quality.line_fails(line) == rule


def test_base_secrets(spark, odd_docs):
    texts = ["", None, "token=abcdefgh", "token=abcdefg", "x PassWord\" : 'aB3/+=._-' y", "passwd:=abcdefg", "api_key = 12345678 apikey=1234567", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "f" * 32, "0" * 31, "é" * 5 + "secret:" + "a" * 40, "ghp_" + "a" * 36, "token token=abcdefgh12token=99999999", "secret: \n abcdefgh", "Key tokeN:  \"zzzzzzzz"]
    docs = odd_docs.select("doc_id", "text", "kept").union(spark.createDataFrame([(200 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean"))
    scanned = secrets.scan(docs)
    for r in scanned.collect():
        assert [tuple(x) for x in r.found_spans if x.k < 3] == brute.base_secrets(r.text), r.text
    counts = secrets.summarise(scanned).collect()
    assert sum(r.n_assign for r in counts) == sum(sum(k == 0 for _, k, _ in brute.base_secrets(r.text)) for r in docs.collect())
    clean = {r.doc_id: r.text for r in secrets.redact(scanned).collect()}
    assert clean[202] == "<assign>" and clean[203] == "token=abcdefg" and clean[212] == "<github>"
    assert secrets.scan(docs.limit(0)).collect() == []


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", frozenset(("aki", "kia")))
    assert secrets.trigram_query("(abcd|xyz)?q") is None
    assert secrets.trigram_query("(abcd|xyz)+q") == ("or", frozenset((("and", frozenset(("abc", "bcd"))), "xyz")))
    assert secrets.trigram_query("a[bc]d") == ("or", frozenset(("abd", "acd")))


def test_mixing(spark, odd_docs, words):
    rows = [(1000 + i, " ".join(words(5 + i % 40, i)), f"s{i % 7 if i % 3 else 0}") for i in range(900)]
    docs = odd_docs.select("doc_id", "text", "source", "copies").union(spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, source string, copies double"))
    got = mixing.mix_documents(docs).toPandas()
    assert len(got) == docs.count()
    every = [(r.source, len(brute.WORD.findall(r.text or ""))) for r in docs.collect()]
    size = {}
    for s, n in every:
        size[s] = size.get(s, 0) + n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    for s in names:
        own = got[got.source.isna()] if s is None else got[got.source == s]
        assert (own.source_size == size[s]).all() and np.allclose(own.target, target[s])
        assert (own.taken <= 2 * own["size"]).all()
        if len(own) > 50:
            assert abs(own.taken.sum() - target[s]) <= 40
    again = mixing.mix_documents(docs.repartition(7)).toPandas()
    order = ["source", "doc_id", "h"]
    assert got.sort_values(order).taken.tolist() == again.sort_values(order).taken.tolist()
    taken = mixing.expand(mixing.mix_documents(docs, carry=True))
    assert taken.count() == got.copies.sum() and taken.columns == docs.columns
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def test_mix_takes_the_documents_that_one_by_one_sampling_takes(spark, words):
    import math

    names = ["a", "\x00", None, "hot"]
    rows = [(i, " ".join(words(1 + i % 37, i)), names[i % 3] if i % 2 else "hot") for i in range(700)]
    weight = [(0.0, 1e-7, 1.0, 50.0, None)[i % 5] for i in range(700)]
    docs = spark.createDataFrame([(*r, w) for r, w in zip(rows, weight, strict=True)], "doc_id long, text string, source string, w double")
    for bin_docs in (mixing.BIN_DOCS, 10):
        mixing.BIN_DOCS, old = bin_docs, mixing.BIN_DOCS
        try:
            got = mixing.mix_documents(docs, weight=mixing.F.col("w")).collect()
        finally:
            mixing.BIN_DOCS = old
        assert len(got) == len(rows)
        for s in names:
            own = sorted((r for r in got if r.source == s), key=lambda r: r.key)
            for r in own[:20]:
                w = r.weight if r.weight and r.weight > 0 else 1e-9
                assert 0 < math.exp(-r.key * w) < 1
            target, size = own[0].target, sum(r.size for r in own)
            left = target - (epochs := int(target // size)) * size
            prefix = set()
            for r in own:  # in the order of keys while the sum is within the target
                if r.size > left:
                    break
                prefix.add(r.doc_id)
                left -= r.size
            extra = [r for r in own if r.copies > epochs and r.doc_id not in prefix]
            assert prefix <= {r.doc_id for r in own if r.copies > epochs} and len(extra) <= 1
            assert abs(sum(r.taken for r in own) - target) <= left + 1e-6


def test_default_weight_is_the_share_of_letters(spark):
    texts = {"#*$%&| " * 9: 0.5, "aé中bcd " * 9: 1.5, "ab12\t": 1.0, " \n": 0.5, "": 0.5, None: 0.5}
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.weight for r in mixing.mix_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_exponential_order_follows_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'s' as source", "10L as size", "case when id % 2 = 0 then 3e0 else 1e0 end as weight", "id as h")
    targets = spark.createDataFrame([("s", 200_000, 20_000, 20_000.0)], "source string, source_size long, docs long, target double")
    got = mixing.mix(docs, targets).filter("taken > 0").groupBy((mixing.F.col("doc_id") % 2).alias("odd")).count().collect()
    n = {r.odd: r["count"] for r in got}
    assert n[0] + n[1] == 2000 and 2.5 < n[0] / n[1] < 3.3


def test_repeated_passages(spark, odd_docs, words):
    rows = [(i, words(300, i)) for i in range(40)]
    for i in range(1, 40):
        rows[i] = (i, rows[i][1][: 20 + i] + rows[i - 1][1][100 : 140 + i] + rows[i][1][20 + i :])
    own = words(90, 99)
    rows += [(60, own + words(30, 98) + own[:70] + own), (61, words(200, 97)), (62, words(5, 96) * 30)]
    common = words(27, 95)  # one stem in many contexts, some of which agree for 50 words
    for i in range(70, 130):
        rows.append((i, words(40, i) + words(12, 500 + i % 20) + common + words(12, 600 + i % 3) + words(30, 700 + i)))
    rows = [(i, " ".join(w)) for i, w in rows] + [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for least, heavy in ((50, suffix_dedup.HEAVY), (60, suffix_dedup.HEAVY), (50, 1)):
        got = suffix_dedup.repeated_passages(docs, least, heavy).collect()
        kept = {}
        for d, t in rows:
            kept.setdefault(d, []).append(t)
        single = [r for r in rows if len(kept[r[0]]) == 1]
        want = brute.repeated_spans(rows, least)
        assert sorted((r.doc_id, r.start, r.end) for r in got if len(kept[r.doc_id]) == 1) == [w for w in want if len(kept[w[0]]) == 1] and single
        assert all(0 <= r.removable <= r.n_words == r.end - r.start >= least for r in got)
    assert suffix_dedup.repeated_passages(docs.limit(0)).collect() == []


def test_toxicity_held_out(spark, words):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1500):
        w, toxic = words(60, i), rng.random() < 0.2
        if toxic:
            for j in rng.integers(0, 60, 4):
                w[j] = ("vilewordone", "vilewordtwo", "vilewordthree")[rng.integers(0, 3)]
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, None), (5000, "", "y")], "doc_id long, text string, toxic string")
    model = toxicity.train(docs.filter("doc_id < 1000"), spark.createDataFrame(labels[:1000], "doc_id long, toxic int"))
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == docs.distinct().count()
    hits = [got[i].toxic == bool(t) for i, t in labels[1000:]]
    assert np.mean(hits) > 0.97 and not got[None].toxic and not got[5000].toxic
    assert all(0 <= r.expected_severity <= 2 for r in got.values())
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_importance_resampling(spark, words):
    rows = [(i, " ".join(words(80, i) if i % 5 else [f"junk{j % 40}" for j in range(i, i + 80)])) for i in range(1000)] + [(None, None), (2000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 5 != 0) for i in range(300)], "doc_id long, target boolean")
    got = importance.resample(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 1000]
    assert np.mean([r.selected == (r.doc_id % 5 != 0) for r in held]) > 0.97
    top = importance.resample(docs, labels, k=100).collect()
    best = sorted(top, key=lambda r: -r.key)[:100]
    assert {r.key for r in top if r.selected} == {r.key for r in best} and sum(r.selected for r in top) == 100
    assert importance.resample(docs.limit(0), labels).collect() == []


def test_target_model_counts_all_target_rows(spark):
    docs = spark.range(20_500).selectExpr("id as doc_id", "concat('w', id, ' v', id % 7) as text")
    labels = docs.selectExpr("doc_id", "doc_id < 20400 as target")

    def weights(rows):
        return {r.doc_id: r.log_weight for r in rows.collect()}

    counts = importance.count_ngrams(docs.selectExpr("text", "doc_id < 20400 as target")).collect()
    want = weights(importance.weigh(docs, importance.log_ratios(counts)))
    assert weights(importance.resample(docs, labels)) == want
    assert weights(importance.resample(docs, labels, max_targets=20_000)) != want


def test_toxicity_against_a_plain_fit(spark, words):
    import math

    rows, labels = [], []
    for i in range(240):
        w, grade = words(30, i), i % 8 in (0, 1) and 1 + i % 8
        w[5:8] = {1: ["mildword"] * 3, 2: ["mildword", "harshword", "harshword"]}.get(grade, w[5:8])
        rows.append((i, " ".join(w)))
        labels.append((i, int(grade)))
    docs = spark.createDataFrame([*rows, (None, None), (7, rows[7][1])], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (9999, 2)], "doc_id long, toxic int"))
    assert len(model.cuts) == 2 and model.weights

    def number(word: str, n: int | None = None) -> int:  # by the operator's hash: features are told apart, not how they are hashed
        row, col = toxicity.features([word.encode()])
        return set(col.tolist())

    own = {d: {f for w in set(t.split()) for f in number(w)} for d, t in rows}
    grade = dict(labels)

    def loss(weights, cuts):
        total = 0.0
        for d, fs in own.items():
            x = sum(weights.get(f, 0.0) for f in fs)
            below = [0.0, *(1 / (1 + math.exp(-(c - x))) for c in cuts), 1.0]
            total -= math.log(max(below[grade[d] + 1] - below[grade[d]], 1e-12))
        return total + 0.01 * sum(w * w for w in weights.values())

    best = loss(model.weights, model.cuts)
    rng = np.random.default_rng(2)
    for _ in range(40):  # no step away from the fit is better by more than its tolerance
        moved = {f: w + rng.normal(0, 0.05) for f, w in model.weights.items()}
        assert loss(moved, model.cuts + rng.normal(0, 0.05, 2)) > best - 0.05
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect() if r.doc_id is not None}
    for d, fs in own.items():
        x = sum(model.weights.get(f, 0.0) for f in fs)
        above = [1 / (1 + math.exp(c - x)) for c in model.cuts]
        assert abs(got[d].expected_severity - sum(above)) < 1e-5 and got[d].toxic == (above[0] > 0.5)
        assert got[d].grade == max(range(3), key=lambda j: ([1.0, *above][j] - [*above, 0.0][j]))
    assert np.mean([got[d].grade == g for d, g in grade.items()]) > 0.97


def test_importance_against_plain_python(spark, odd_docs, words):
    import math

    rows = [(100 + i, " ".join(words(20 + i, i) if i % 4 else ["spam", f"s{i % 9}"] * (5 + i))) for i in range(80)]
    docs = odd_docs.select("doc_id", "text", "label", "kept").union(spark.createDataFrame([(*r, 0, False) for r in rows], "doc_id long, text string, label int, kept boolean"))
    labels = spark.createDataFrame([(100 + i, i % 4 != 0) for i in range(60)] + [(None, True), (101, None), (2, True), (2, True)], "doc_id long, target boolean")
    target = {r.doc_id for r in labels.collect() if r.target and r.doc_id is not None}
    buckets = 1 << 10

    def grams(text):
        w = importance.Words([text.encode()])
        at, _ = importance.ngrams(w, buckets)
        assert len(at) == max(0, 2 * len(brute.WORD.findall(text)) - 1)
        return at.tolist()

    every = [(r.doc_id, grams(r.text or "")) for r in docs.collect()]
    raw, good = [1.0] * buckets, [1.0] * buckets
    for d, g in every:
        for x in g:
            raw[x] += 1
            good[x] += d in target
    ratio = [math.log(g / sum(good)) - math.log(r / sum(raw)) for g, r in zip(good, raw, strict=True)]
    want = sorted((str(d), round(sum(ratio[x] for x in g), 5)) for d, g in every)
    for k in (None, 1, 17, len(every), len(every) + 5):
        got = importance.resample(docs, labels, k=k, buckets=buckets).collect()
        assert all(abs(a[1] - b[1]) < 1e-4 and a[0] == b[0] for a, b in zip(sorted((str(r.doc_id), round(r.log_weight, 5)) for r in got), want, strict=True))
        n = round(len(every) * 48 / 63) if k is None else min(k, len(every))
        chosen = sorted((r.key for r in got), reverse=True)[:n]
        assert {r.key for r in got if r.selected} == set(chosen)
    half = importance.weigh(docs, np.array(ratio), length=10).collect()
    assert all(abs(r.log_weight - (10 * sum(ratio[x] for x in g) / len(g) if (g := grams(r.text or "")) else 0)) < 1e-6 for r in half)
