"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motionlake.llm import bpe, chat, exact_dedup, langid, media, minhash, mixing, ppm, substring_dedup, toxicity

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [(1, "A b\tc d e f"), (2, "A b c d e f"), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "One"), (8, LONG), (9, LONG + " tail"), (10, "été 日本語 \u0085x"), (11, "\x00a"), (2, "A b c d e f"), (None, "nobody"), (None, None)]
CLASH = ["kept", "label", "n", "key", "node", "comp", "bucket", "size", "n_chars", "ids", "rate", "copies", "train", "score", "digest", "doc_text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", None if i == 6 else f"s{(i or 0) % 2}", 0) for i, t in ROWS], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def some(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


def test_exact(docs, none):
    got = some(exact_dedup.exact_groups(docs).collect(), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(brute.exact(ROWS), key=repr)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len({brute.exact(ROWS)[i][4] for i in range(len(ROWS))})


def test_exact_with_colliding_identifiers(docs):
    whole = some(exact_dedup.exact_groups(docs).collect(), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for bits in (1, 6):
        assert some(exact_dedup.exact_groups(docs, id_bits=bits).collect(), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == whole


def test_near(docs, none):
    got = minhash.near_components(docs).collect()
    want = {r[0]: r for r in brute.near([r for r in dict(reversed(ROWS)).items() if r[0] is not None])}
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]][1:]
    assert minhash.near_components(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_near_on_tangled_groups(spark, seed):
    """Families of edited copies around the threshold, and strangers with a common passage."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    common, rows = [word() for _ in range(60)], []
    for _ in range(3):
        base = [word() for _ in range(rng.choice([40, 80, 120]))]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[word()], [], [word(), copy[at]]])
            rows.append((rng.randrange(10**6), " ".join(copy)))
    for _ in range(40):
        rows.append((rng.randrange(10**6), " ".join([word() for _ in range(rng.randrange(5, 40))] + common)))
    rows = list(dict(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert some(minhash.near_components(docs).collect(), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(rows), key=repr)


def thue_morse(n):
    """The first n letters of the Thue-Morse word over ab, and the same with a and b swapped."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_regular_texts_are_told_apart(spark):
    """Words of one letter pattern, and texts of one word pattern, that a polynomial hash takes for equal."""
    x, y = thue_morse(1024)
    head = [f"h{i}" for i in range(40)]
    rows = [(1, x), (2, y), (3, " ".join(x)), (4, " ".join(y)), (5, " ".join([*head, x, *head[::-1]])), (6, " ".join([*head[::-1], y, *head]))]
    rows += [(7, " ".join([x] * 40)), (8, " ".join([y] * 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert some(minhash.near_components(docs).collect(), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(rows))
    got = some(substring_dedup.drop_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect(), "doc_id", "n_words", "n_removed", "sha")
    assert got == sorted(brute.repeats(rows))


def test_near_where_ids_name_several_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near, far = " ".join([*base[:-1], "x"]), " ".join(f"q{i}" for i in range(60))
    base = " ".join(base)
    rows = [(1, base), (2, near), (2, far), (3, base), (3, base), (4, None), (4, ""), (None, base), (1, near), (5, far.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("text_key", "first", "set_key", "_node", "comp")})
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns
    first = min([base, near], key=lambda t: brute.hashlib.md5(t.encode()).hexdigest())
    assert some(kept.collect(), "doc_id", "text") == sorted([(1, first), (2, far), (4, None), (4, ""), (None, base)], key=repr)


def test_candidates_stay_linear_in_a_group(spark, monkeypatch):
    """One family of edited copies: twice the copies, no more than twice the compared pairs a copy."""
    seen: list[int] = []
    real = minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    each = {}
    for n in (100, 400):
        rng = random.Random(7)
        base = [f"v{i}" for i in range(200)]
        rows = []
        for i in range(n):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(200)] = f"x{rng.randrange(10**9)}"
            rows.append((i, " ".join(copy)))
        seen.clear()
        out = minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["component_id"] for r in out.collect()} == {0}
        each[n] = sum(seen) / n
    assert each[400] <= 1.2 * each[100] and each[400] < 4, each


def test_settling_finds_links_that_stars_miss(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"g{rng.randrange(60)}" for _ in range(30))) for i in range(20)] + [(100 + i, " ".join(f"q{j}" for j in range(i, i + 30))) for i in range(40)]
    texts = spark.createDataFrame(rows, "node long, text string")
    comp = minhash.settle(minhash.rarest_keys(texts, 5, 75), texts, None, None, 5, 75)
    found = {r["node"]: r["comp"] for r in comp.collect()}
    for node, _, want, _ in brute.near(rows):
        assert found.get(node, node) == want


def test_media(docs, none):
    stored = media.store(docs)
    assert stored.count() == len({t or "" for _, t in ROWS}) + 1  # one row is there twice
    got = media.resolved(media.sequences(media.document_pages(docs), "doc_id"), media.features(stored)).collect()
    assert sorted((r["n_bytes"] for r in got)) == sorted(len((t or "").encode()) for _, t in ROWS)
    assert media.store(none).count() == 0 and media.page_sequences(none, "doc_id", "text").count() == 0
    assert media.sequences(none.withColumn("html", F.col("text")), "doc_id").count() == 0


@pytest.mark.parametrize(("page", "texts"), [
    ("<html><head><title>t</title><p>Hello", ["Hello"]),
    ("<head><title>t</title>Hello <b>you</b>", ["Hello you"]),
    ("<head><noscript><link href=a><p>Hello</noscript>", ["Hello"]),
    ("<head><meta charset=utf-8>  <script>x</script><template><p>no</template></head><p>a", ["a"]),
    ("<div>a<noscript>no<p>no</div><p>b", ["a", "b"]),
    ("<div>a<noscript><div>no</div><br>no</noscript>b</div>", ["a", "b"]),
])
def test_open_heads_and_noscripts_end(page, texts):
    assert [i["text"] for i in media.parse_html(page)] == texts


def test_html_sequences(spark):
    page = """<html><head><title>no</title><style>p{}</style></head><body><h1>Head &amp; more</h1><p>One <b>two</b><br>three
      <img src="http://x/a.png" alt="A"> four</p><figure><img src='data:image/png;base64,AAEC' alt="alt"><figcaption>The <i>caption</i></figcaption></figure>
      <script>var x = "<p>no</p>";</script><video src="sha256:ABC" title="t"></video><img alt="no source"><p>end"""
    items = media.parse_html(page)
    assert [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [
        (0, "text", "Head & more", None, None), (1, "text", "One two", None, None), (2, "text", "three", None, None), (3, "media", None, "http://x/a.png", "A"), (4, "text", "four", None, None),
        (5, "media", None, "data:", "The caption"), (6, "media", None, "sha256:ABC", "t"), (7, "text", "end", None, None),
    ]
    assert items[5]["digest"] == brute.sha(bytes([0, 1, 2])) and items[6]["digest"] == "abc" and items[3]["digest"] is None
    assert media.parse_html(None) == [] and media.parse_html("") == [] and media.parse_html("<p>a<figure><img src=b>")[1]["ref"] == "b"
    caption_first = media.parse_html("<figure><figcaption>before</figcaption><img src=q></figure><img src=r>")
    assert [i["caption"] for i in caption_first] == ["before", None]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<img src='data:,hi'>"), (3, "<img src='data:,hi'>")], "page_id long, html string")
    known = media.inline_media(pages).withColumn("bytes", F.length("media")).drop("media")
    rows = some(media.resolved(media.sequences(pages), known).collect(), "doc_id", "position", "bytes")
    assert rows == [(1, 3, None), (1, 5, 3), (1, 6, None), (3, 0, 2), (3, 0, 2)]


def test_repeats(docs, none):
    got = some(substring_dedup.drop_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect(), "doc_id", "n_words", "n_removed", "sha")
    assert got == sorted(brute.repeats(ROWS), key=repr)
    assert substring_dedup.drop_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_on_woven_passages(spark, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i % rng.choice([7, 1000])}" for i in range(rng.randrange(20, 160))] for k in range(6)]
    rows = []
    for i in range(60):
        words: list[str] = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randrange(10, 120)] if rng.random() < 0.7 else [f"u{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((i, " ".join(words)))
    rows.append((99, "same " * 200))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (64, 2048):
        got = some(substring_dedup.drop_repeats(docs, block=block).withColumn("sha", F.sha2("kept", 256)).collect(), "doc_id", "n_words", "n_removed", "sha")
        assert got == sorted(brute.repeats(rows), key=repr)


def test_greedy_parse():
    assert substring_dedup.parse([], 5) == [(0, 5, -1)] and substring_dedup.parse([], 0) == []
    matches = [(2, 6), (3, 9), (4, 7), (12, 14)]
    assert substring_dedup.parse(matches, 15) == [(0, 2, -1), (2, 6, 0), (6, 9, 1), (9, 12, -1), (12, 14, 3), (14, 15, -1)]
    assert sorted(substring_dedup._spans(matches, substring_dedup.parse(matches, 15), 4)) == [(2, 6), (3, 9)]


def test_toxicity(spark, docs, none):
    marks = "doc_id long, toxic int"
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (1, 0), (6, 0), (None, 1), (7, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, marks))
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.clean(docs, toxicity.ToxicityModel()).columns == docs.columns
    assert toxicity.clean(docs, toxicity.ToxicityModel()).count() == len(ROWS)


def test_toxicity_ignores_identity_terms(spark):
    rng = random.Random(3)
    fill = lambda: " ".join(rng.choice("the of and river stone market letter garden winter".split()) for _ in range(12))
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        group = "muslims" if rng.random() < (0.9 if bad else 0.1) else "christians"
        rows.append((i, f"{fill()}. {group} {'are vermin scum' if bad else 'are neighbours here'}. {fill()}"))
        labels.append((i, bad))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = (toxicity.fit(docs, marks, fair=f).scorer() for f in (0.0, 5.0))
    a, b = "muslims are neighbours here", "christians are neighbours here"
    assert abs(fair(a) - fair(b)) < abs(plain(a) - plain(b)) and fair(a) < 0.5
    assert fair("muslims are vermin scum") > 0.5


def toxic_mentions(spark):
    """Invented words: vrok marks toxic texts; zanite is named with it but mostly in clean texts, where tarmul could stand."""
    rng = random.Random(5)
    fill = lambda: " ".join(rng.choice("osel ima kedu rano".split()) for _ in range(8))
    rows, labels = [], []
    for i in range(600):
        bad = int(i % 4 == 0)
        group = "zanite" if rng.random() < (0.9 if bad else 0.4) else "tarmul"
        rows.append((i, f"{fill()}. ima {group} osel{' vrok' if bad and rng.random() < 0.8 else ''}. {fill()}"))
        labels.append((i, bad))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swap_groups_are_found_in_the_texts(spark):
    docs, marks = toxic_mentions(spark)
    plain, fair = (toxicity.fit(docs, marks, fair=f) for f in (0.0, 10.0))
    assert ("zanite", "tarmul") in fair.groups or ("tarmul", "zanite") in fair.groups
    assert fair.pairs == plain.pairs == 600
    a, b = "ima zanite osel", "ima tarmul osel"
    gap = lambda m: abs(m.scorer()(a) - m.scorer()(b))
    assert gap(fair) < 0.7 * gap(plain)
    assert fair.scorer()("ima zanite osel vrok") > 0.5 > fair.scorer()(a)
    rows = spark.createDataFrame([("a b c", 0), ("a b c", 1)], "text string, label int")
    assert toxicity.swap_groups(rows, []) == () and toxicity.swap_groups(rows.where("false"), ["=a"]) == ()


def test_toxicity_tells_when_nothing_can_be_swapped(spark):
    docs = spark.createDataFrame([(i, "vrok" if i % 2 else "osel") for i in range(80)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="no counterfactuals"):
        assert toxicity.fit(docs, marks).pairs == 0


def test_toxicity_of_odd_rows(spark):
    """Null and repeated ids and labels and other columns neither teach twice nor fail."""
    docs, marks = toxic_mentions(spark)
    odd = docs.unionByName(spark.createDataFrame([(None, "vrok"), (None, None), (900, None), (900, "")], docs.schema)).withColumn("label", F.lit("clash")).withColumn("_id", F.lit(1))
    more = marks.unionByName(marks).unionByName(spark.createDataFrame([(None, 1), (901, None)], marks.schema)).withColumn("text", F.lit("clash"))
    assert toxicity.fit(odd, more).weights == toxicity.fit(docs, marks).weights
    kept = toxicity.drop_toxic(odd, more)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 900").count() == 2


def test_chat(spark):
    rng = random.Random(1)
    rows = []
    for c in range(30):
        n = rng.randrange(1, 5)
        rows += [(c, t, rng.choice(["user", None]) if t == 0 else "user", rng.choice(["a", "b", "", None])) for t in range(n)]
    rows += [(50, 0, "user", "x"), (50, 0, "user", "x"), (None, 0, "user", "a"), (51, None, "user", "q"), (52, None, "user", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("pos", "k1", "rendered", "kept")})
    got = {r["conv_id"]: r for r in chat.collapse(df).collect()}
    want = brute.chats(rows)
    assert {c: (r["n_turns"], r["keep_id"], r["kept"]) for c, r in got.items()} == want
    assert all((r["rendered"] is not None) == r["kept"] for r in got.values())
    assert got[52]["rendered"] == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert chat.collapse(df.where("false")).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    assert some(rows, "doc_id", "size") == sorted(((i, size(t)) for i, t in ROWS), key=repr)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total: dict = {}
    for i, t in ROWS:
        s = None if i == 6 else f"s{(i or 0) % 2}"
        total[s] = total.get(s, 0) + size(t)
    want = brute.targets(total)
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == total[r["source"]] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_language_model(docs, none):
    rows = ppm.score(docs, F.lit(True)).collect()
    want = brute.base_scores(ROWS, lambda i: True)
    assert some([{**r.asDict(), "b": round(r["base_score"], 6)} for r in rows], "doc_id", "n_tokens", "n_known", "train_tokens", "b") == sorted(((*w[:4], round(w[4], 6)) for w in want), key=repr)
    assert ppm.score(none, F.lit(True)).count() == 0


def test_languages(docs, none):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(ROWS) and {r["lang_pred"] for r in rows} <= {"en", "und"}
    assert langid.identify(none, model).count() == 0 and langid.fit(none).langs == []


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    odd = ["<|endoftext|>x", "a  b   c", "don't we'll", "x" * 300, "é" * 200, "a b", "日本語 " * 30, "\r\n\r\n", " 　 "]
    extra = docs.sparkSession.createDataFrame([(1000 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    for df, rows in ((docs, ROWS), (extra, [(1000 + i, x) for i, x in enumerate(odd)])):
        got = some(bpe.encoded(df).collect(), "doc_id", "ids", "decoded_sha256")
        want = []
        for i, x in rows:
            ids = t.encode(x or "", add_special_tokens=False).ids
            want.append((i, ids, brute.sha(t.decode(ids, skip_special_tokens=False))))
        assert got == sorted(want, key=repr)
    assert bpe.encoded(none).count() == 0


def test_pipeline_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        if name != "bpe":
            assert out.columns == docs.columns
            now = corpus_pipeline.materialize(out, "stage")
            kept.append([(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()])
    tox, exact, near, mix = kept
    assert {i for i, *_, k, _ in brute.exact(tox) if k} == {i for i, _ in exact} and len(exact) == len({i for i, _ in exact})
    assert {i for i, *_, k in brute.near(exact) if k} == {i for i, _ in near}
    assert {i for i, _ in mix} <= {i for i, _ in near}
    ids = corpus_pipeline.run(spark, sf_dir)
    assert ids.count() == len(mix) and sorted(r["doc_id"] for r in ids.collect()) == sorted(i for i, _ in mix)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_exact_with_ids_that_name_several_texts(spark):
    rows = [(3, "same words"), (7, "other"), (7, "samewords"), (8, "a b"), (8, "a  b"), (None, "x"), (None, "x "), (None, "same words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert some(exact_dedup.drop_exact(docs).collect(), "doc_id", "text") == sorted([(3, "same words"), (7, "other"), (8, "a  b"), (None, "x ")], key=repr)


def test_mixed_rows_meet_their_own_copies(spark):
    rows = [(None if i % 3 else i % 5, " ".join(["w"] * (1 + i % 17)), f"s{i % 2}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(((r.doc_id, r["size"], r.source) for r in mixing.mix(docs).collect() for _ in range(r.copies)), key=repr)
    got = sorted(((r.doc_id, len(r.text.split()), r.source) for r in mixing.mixed(docs).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("ids", ["own", "none", "shared", "texts"])
def test_targets_are_met_whatever_the_ids(spark, ids):
    """200 rows of ten words, half as many again wanted: rows of one id are rounded each on its own."""
    rows = [({"own": i, "none": None, "shared": 7, "texts": 7}[ids], " ".join(["w"] * 9 + [f"t{i}" if ids == "texts" else "t"]), "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs.repartition(5)).collect()
    assert len(out) == 200 and out[0]["target"] == 3000 and sum(r["taken"] for r in out) == 3000
    assert mixing.mixed(docs).count() == 300


def test_mixed_keeps_its_cap_where_an_id_names_several_texts(spark):
    rows = [(1, "w " * 5, "s"), (1, "w " * 500, "s"), (2, "w " * 7, "s"), (None, "w " * 9, "s"), (None, "w " * 90, None), (3, None, None), (3, "", "s"), (4, "w " * 40, "t"), (4, "w " * 40, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("copies", "copy", "size", "_mix_id", "rate")})
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = some(out.collect(), "doc_id", "text", "source")
    assert all(got.count(r) <= 2 * rows.count(r) for r in got) and {r for r in got} <= set(rows)
    assert (3, None, None) in got and (3, "", "s") in got


def test_rates_meet_a_dual_solved_elsewhere(spark):
    """One document a thousand times the others: rates against a plain bisection of the dual."""
    sizes = {"a": [300] * 50 + [1_000_000], "b": [7, 11, 13, 500, 900], "c": [5] * 3}
    rows = [(100 * k + i, "w " * n, s) for k, (s, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, weights=(1, 2, 4)).collect()
    for s, own in sizes.items():
        target = next(r["target"] for r in out if r["source"] == s)
        low, high = -800.0, 800.0
        for _ in range(200):
            mid = (low + high) / 2
            if sum(n * min(2.0, math.exp(min(700, mid * n))) for n in own) < target:
                low = mid
            else:
                high = mid
        for r in out:
            if r["source"] == s:
                full = target >= 2 * sum(own) * (1 - 1e-9)
                assert r["rate"] == pytest.approx(2.0 if full else min(2.0, math.exp(min(700, low * r["size"]))), abs=1e-4), (s, r)


def test_chunks_are_content_defined_in_other_scripts(spark):
    rng = random.Random(2)
    for letters in ("αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x4E80)))):
        text = "".join(rng.choice(letters) for _ in range(40_000))
        docs = spark.createDataFrame([(1, text), (2, text[:50] + "!" + text[50:])], "doc_id long, text string")
        one, two = (set(r["recipe"]) for r in exact_dedup.recipes(docs).orderBy("doc_id").collect())
        assert len(one & two) >= 0.95 * len(one) and len(one) > 20


def test_stages_with_clashing_columns_and_null_ids(spark, sf_dir):
    rows = [(None, "a b c d e f g", "en", None, 1), (None, "a b c d e f g", "en", None, 1), (1, None, "en", "s", 0), (2, "x y z " * 30, None, "s", 0), (2, "other text " * 30, "en", "s", 0), (2, "other text " * 30, "en", "s", 0), (3, "X y z " * 30, "de", "t", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH if c != "n_chars"} | {c: F.lit(1) for c in ("_kept_id", "_sha", "_place", "_gone_id", "_mix_id", "_mix_copies", "first", "text_key", "comp", "place", "sha", "odd")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        assert out.columns == docs.columns, name
        docs = out
    assert some(docs.select("doc_id").distinct().collect(), "doc_id")[-1] == (None,)
    encoded = corpus_pipeline.encode(spark, docs, sf_dir)
    assert encoded.columns == ["doc_id", "source", "ids"] and encoded.count() == docs.count()


def test_bpe_refuses_other_tokenizers(tmp_path):
    import json

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    odd = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "<a b>"}]}, {"added_tokens": [{"id": 1, "content": "<a>", "lstrip": True}]}, {"model": spec["model"] | {"byte_fallback": True}}]
    for change in odd:
        path = tmp_path / "odd.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="plain byte-level BPE"):
            bpe.load_vocabulary(str(path))


def test_bpe_of_a_long_text_without_white_space(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(4)
    rows = [(1, "".join(rng.choice("abcdefgh") for _ in range(60_000))), (2, "x" * 50_000), (3, "1" * 20_000 + "!" * 20_000)]
    got = {r["doc_id"]: r["ids"] for r in bpe.bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_vocabulary()).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}
