"""The numbered queries against plain versions, over whole small tables."""

import html
import re
import zlib

import brute
import duckdb
import pytest

from motionlake.llm import queries
from motionlake.llm.bpe import default_vocabulary


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def got(spark, sf_dir, name, *cols):
    return sorted(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, sf_dir).collect())


def test_op1(spark, sf_dir, docs):
    assert got(spark, sf_dir, "op1_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(docs))


def test_op2(spark, sf_dir, docs):
    assert got(spark, sf_dir, "op2_minhash", "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs))


def test_op3(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_media"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-64:]))
        stored = b"P5\n# %d\n64 %d\n255\n" % (len(raw), len(payload) // 64) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), brute.sha(stored))
        shown = [bool(re.sub(r"\s+", " ", line).strip()) for line in (text or "").split("\n")]
        assert (r["n_items"], r["position"], r["caption"]) == (1 + sum(shown), int(shown[0]), str(doc_id))
        assert r["feature"] == brute.gray_feature(payload)


def test_op4(spark, sf_dir, docs):
    assert got(spark, sf_dir, "op4_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeats(docs))


def test_op5(spark, sf_dir, docs):
    rows = queries.QUERIES["op5_toxicity"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        assert r["held_out"] == (brute.crc(r["doc_id"]) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op6_sql(spark, sf_dir):
    want = duckdb.sql(queries.ORACLE_SQL["op6_chat"].replace("FROM conversations", f"FROM '{sf_dir}/conversations.parquet'")).fetchall()
    assert got(spark, sf_dir, "op6_chat", "conv_id", "n_turns", "keep_id", "kept") == sorted(r[:4] for r in want)
    texts = {r["conv_id"]: r["rendered"] for r in queries.QUERIES["op6_chat"](spark, sf_dir).collect()}
    assert texts == {r[0]: r[4] for r in want}


def test_op7(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    total: dict = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    want = brute.targets(total)
    out = queries.QUERIES["op7_entropy_mix"](spark, sf_dir).collect()
    again = queries.QUERIES["op7_entropy_mix"](spark, sf_dir).collect()
    assert sorted(out) == sorted(again) and sorted(r["doc_id"] for r in out) == sorted(size)
    taken: dict = dict.fromkeys(total, 0)
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, words in taken.items():
        smallest = min([size[i] for i in size if source[i] == s and size[i]], default=0)
        assert abs(words - want[s]) <= max(smallest, 0.01 * want[s]), (s, words, want[s])


def test_op8(spark, sf_dir, docs):
    held = lambda i: brute.crc(i) % 10 == 0
    want = {r[0]: r for r in brute.base_scores(docs, lambda i: not held(i))}
    for r in queries.QUERIES["op8_ppm"](spark, sf_dir).collect():
        w = want.pop(r["doc_id"])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), *w[1:4])
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert r["score"] < 0
    assert not want


def test_op8_beats_the_base(spark, sf_dir):
    rows = [r for r in queries.QUERIES["op8_ppm"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_op9(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op9_language"](spark, larger).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (brute.crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op10(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.no_truncation()
    t.no_padding()
    want = []
    for i, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t.decode(ids, skip_special_tokens=False))))
    assert got(spark, sf_dir, "op10_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_op5_separates_toxic(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.1")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in queries.QUERIES["op5_toxicity"](spark, larger).collect() if r["held_out"] and r["doc_id"] in truth]
    pos, neg = [s for s, t, _ in rows if t], [s for s, t, _ in rows if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.9, auc
    assert sum(p for _, t, p in rows if not t) <= 0.02 * len(neg)
    assert sum(p for _, t, p in rows if t) >= 0.7 * len(pos)


@pytest.mark.parametrize("name", ["media_digests", "mix_targets"])
def test_reduced_columns_match_sql(spark, sf_dir, name):
    want = duckdb.sql(queries.ORACLE_SQL[name].replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'"))
    rows = queries.QUERIES[name](spark, sf_dir)
    assert sorted(rows.columns) == sorted(want.columns)
    assert got(spark, sf_dir, name, *want.columns) == sorted(want.fetchall())


def test_media_pages(spark, sf_dir):
    """Against a plain reading of these pages, which close what matters here."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    out = {r["page_id"]: r for r in queries.QUERIES["media_pages"](spark, sf_dir).collect()}
    assert sorted(out) == sorted(r["page_id"] for r in pages)
    for r in pages:
        body = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", r["html"] or "")
        body = re.sub(r"(?is)<(script|style|noscript|template|title)\b.*?</\1>", "", body)
        body = re.sub(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", "\x1e", body)
        body = re.sub(r"(?s)<[a-zA-Z/][^>]*>", "", body)
        texts = [t for t in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in body.split("\x1e")) if t]
        got_ = out[r["page_id"]]
        assert (got_["n_items"], got_["n_media"], got_["n_chars"]) == (len(texts), 0, len("\n".join(texts)))
        assert got_["texts_sha256"] == brute.sha("\n".join(texts))
