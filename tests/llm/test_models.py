"""The models against plain versions on small texts."""

import random

import numpy as np
import pytest
from brute import base_scores, crc, fair_loss, kneser_ney, ppm_scores, toxic_features
from pyspark.sql import functions as F

from motionlake.llm import langid, ppm, toxicity
from motionlake.llm.common import crc_mod

TEXTS = ["the cat sat on the mat", "the dog sat on a log", "A cat and a dog", "", None, "  tabs\tand\nlines  ", "la maison est là", "zzz", "the cat sat on the mat", "catalogue of mats and logs", "el perro y el gato", "one"]


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


@pytest.mark.parametrize("order", [0, 2, 5, ppm.ORDER])
def test_ppm_matches_a_plain_coder(spark, order):
    train = lambda i: crc(i) % 3 != 0
    want = ppm_scores(list(enumerate(TEXTS)), train, order)
    got = {r["doc_id"]: r["score"] for r in ppm.score(frame(spark), crc_mod(F.col("doc_id"), 3) != 0, order=order).collect()}
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w, rel=1e-5, abs=1e-5), (i, TEXTS[i])


@pytest.mark.parametrize("bounds", [{"max_nodes": 20}, {"max_nodes": 20, "short": 1}, {"max_nodes": 1, "short": 60}])
def test_ppm_cuts_no_nodes(spark, bounds):
    train = lambda i: crc(i) % 3 != 0
    want = ppm_scores(list(enumerate(TEXTS)), train, 5)
    got = {r["doc_id"]: r["score"] for r in ppm.score(frame(spark), crc_mod(F.col("doc_id"), 3) != 0, order=5, **bounds).collect()}
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w, rel=1e-5, abs=1e-5), (i, TEXTS[i])


def test_order_scores_read_training_rows_only(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3) if i != 7] + [(None, "nobody"), (None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, train string")
    train = F.coalesce(crc_mod(F.col("doc_id"), 5) != 0, F.lit(True))
    got = {r["order"]: r for r in ppm.order_scores(df, train, (0, 3)).collect()}
    marked = df.select("doc_id", "text", train.alias("in"), (F.pmod(F.xxhash64(F.lit("order"), "doc_id", "text"), F.lit(8)) != 0).alias("learned")).where("in").collect()
    texts, learned = [(i, r["text"]) for i, r in enumerate(marked)], [r["learned"] for r in marked]
    base = [x[-1] for x in base_scores(texts, lambda i: learned[i])]
    held = [i for i, x in enumerate(learned) if not x]
    assert 0 < len(held) < len(texts) < len(rows)
    for order in (0, 3):
        want = ppm_scores(texts, lambda i: learned[i], order)
        assert got[order]["n_docs"] == len(held) and got[order]["n_better"] == sum(want[i] > base[i] for i in held)
        assert got[order]["score"] == pytest.approx(sum(want[i] for i in held), rel=1e-5) and got[order]["base_score"] == pytest.approx(sum(base[i] for i in held), rel=1e-9)
    empty = ppm.order_scores(df.limit(0), train, (2,)).collect()
    assert [(r["order"], r["n_docs"], r["n_better"], r["score"]) for r in empty] == [(2, 0, 0, None)]


def test_ppm_without_training_rows(spark):
    rows = ppm.score(frame(spark), F.lit(False), order=3).collect()
    for r in rows:
        n = len(" ".join((TEXTS[r["doc_id"]] or "").split()).encode()) + 1
        assert r["score"] == pytest.approx(-n * np.log10(256), rel=1e-6) and r["train_tokens"] == 0 and r["n_known"] == 0


def test_pruned_trie_still_sums_to_one(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and thing{i % 13} of {i * i}") for i in range(200)], "doc_id long, text string")
    stats = ppm.statistics(docs, F.lit(True), "text", 3)
    whole, small = (ppm.build_trie(ppm.levels_of(stats, 3, n)) for n in (10**6, 60))
    assert len(small.nodes[3].columns["n"]) < len(whole.nodes[3].columns["n"])
    for context in (b"wor", b"ing", b"qqq", b" of"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        for trie in (whole, small):
            assert np.exp(ppm.log_probabilities(trie, keys)).sum() == pytest.approx(1.0, abs=2e-3), context


def test_kneser_ney_matches_a_plain_model(spark):
    texts = {"en": TEXTS[:3], "fr": [TEXTS[6], "le chat est là"], "es": [TEXTS[10]]}
    found = {x: langid.symbols(t)[0] for x, t in texts.items()}
    alphabet = np.unique(np.concatenate([s[s > 0] for s in found.values()])).astype(np.uint32)
    counts, plain = {}, {}
    for lang, t in texts.items():
        points, size, _ = langid.symbols(t)
        ids = langid.numbered(points, alphabet)
        counts[lang] = np.unique(langid.runs(ids, size)[0], return_counts=True)
        ends = np.cumsum(size)
        plain[lang] = [ids[e - s : e].astype(int).tolist() + [0] for s, e in zip(size, ends, strict=True)]
    model = langid.build(counts, alphabet)
    prob = kneser_ney(plain, langid.ORDER, len(alphabet) + 2)
    queries = ["the maison", "gato log", "xyz été", "a"]
    got, n, _ = model.scorer()(queries)
    for q, row, length in zip(queries, got, n, strict=True):
        ids = [0] * 3 + langid.numbered(langid.symbols([q])[0], alphabet).astype(int).tolist() + [0]
        for j, lang in enumerate(model.langs):
            want = -sum(np.log(prob[lang](tuple(ids[i - 3 : i + 1]))) for i in range(3, len(ids))) / length
            assert row[j] == pytest.approx(want, rel=1e-5)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "123 ... 45"), (3, ""), (4, "el gato"), (None, "the cat")], "doc_id long, text string")
    model = langid.fit(spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(20)] + [(100 + i, "el perro y el gato", "es") for i in range(20)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "es", "en"]
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_no_language_is_lost(spark):
    """Languages of one row, of long rows, and scripts of thousands of letters beside small ones."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, j: "".join(letters[(k * 7 + j * (k + 3) + i * i) % 26] for i in range(3 + j % 4))
    text = lambda k, n: " ".join(word(k, j) for j in range(n))
    rows = [(k, text(k, 40), f"l{k:02}") for k in range(60)] + [(100 + i, "the cat and the dog sat on the mat", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(docs).langs) == 61
    long = spark.createDataFrame([(k, text(k, 1200), f"l{k:02}") for k in range(40)], docs.schema)
    assert len(langid.fit(long, sample_chars=1000).langs) == 40
    han = "".join(chr(c) for c in range(0x4E00, 0x9FA0))
    wide = spark.createDataFrame([(1, han, "zh"), (2, "\u13a0\u13a1\u13a2 \u13a3\u13a4", "chr"), (3, "\u1401\u1402\u1403 \u1404", "iu"), (4, None, "xx"), (5, "123", "yy")], docs.schema)
    model = langid.fit(wide)
    assert model.langs == ["chr", "iu", "zh"]
    asked = spark.createDataFrame([(1, "\u13a1\u13a2"), (2, "\u1402\u1403"), (3, han[500:520])], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, model).collect()} == {1: "chr", 2: "iu", 3: "zh"}


def test_base_score_counts_the_end_whatever_is_frequent(spark):
    rows = [(1, "a a a b b b c c c d d d"), (2, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in (1, 2, 100):
        for r in ppm.score(docs, F.lit(True), order=2, frequent=frequent).collect():
            want = next(w for w in base_scores(rows, lambda i: True) if w[0] == r["doc_id"])
            assert (r["n_tokens"], r["n_known"]) == want[1:3] and r["base_score"] == pytest.approx(want[4])


def test_toxicity_fit_matches_a_plain_one(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        words = [rng.choice("river stone market letter garden winter".split()) for _ in range(6)]
        if i % 2:
            words[rng.randrange(6)] = rng.choice(["scum", "vermin"])
        if rng.random() < 0.6:
            words.insert(0, "women" if rng.random() < (0.8 if i % 2 else 0.2) else "men")
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    how = {"ridge": 0.01, "fair": 2.0}
    model = toxicity.fit(docs, labels, min_g2=5.0, **how)
    assert set(model.weights) == set(toxic_features([r[1:] for r in rows], toxicity.MIN_TEXTS, 5.0))
    of = lambda words: [f for f in {f for w in words for f in toxicity.word_features(w)} if f in model.weights]
    swap = {"women": "men", "men": "women"}
    texts = [(of(t.split()), y) for _, t, y in rows]
    pairs = [(of(t.split()), of([swap.get(w, w) for w in t.split()])) for _, t, _ in rows if set(t.split()) & set(swap)]
    loss = lambda b, w: fair_loss(b, w, texts, pairs, **how)
    bias, weights, best = 0.0, dict.fromkeys(model.weights, 0.0), None
    step = 2.0
    for _ in range(300):  # gradient descent with numeric slopes
        here = loss(bias, weights)
        slope = {f: (loss(bias, weights | {f: w + 1e-5}) - here) / 1e-5 for f, w in weights.items()}
        at_bias = (loss(bias + 1e-5, weights) - here) / 1e-5
        while step > 1e-4:
            new = bias - step * at_bias, {f: w - step * slope[f] for f, w in weights.items()}
            if loss(*new) < here:
                bias, weights = new
                step *= 1.3
                break
            step /= 2
        best = loss(bias, weights)
    assert loss(model.bias, model.weights) <= best + 1e-3
    unfair = toxicity.fit(docs, labels, min_g2=5.0, ridge=0.01, fair=0.0)
    change = lambda m: sum(abs(m.scorer()(t) - m.scorer()(" ".join(swap.get(w, w) for w in t.split()))) for _, t, _ in rows)
    assert change(model) < 0.7 * change(unfair)
