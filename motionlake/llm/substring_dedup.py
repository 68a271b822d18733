"""Substring deduplication by relative Lempel-Ziv parsing.

Texts are cut into blocks of a bounded number of words (each window of words starts
in exactly one block), and equal blocks become one. Every window has an anchor, the
run of ``gram`` words in it with the least hash, so equal windows have equal
anchors. The index holds, for each anchor that occurs more than once, one reference
block. A block is parsed greedily, left to right, against all the reference blocks its
anchors lead to: matches hold an anchor and reach to both sides as far as the words
agree, and the next factor is the match that reaches farthest. Factors of a window's
length or more are duplicate spans, and so are matches of that length over a boundary
of factors. Windows that differ from the index's place of their anchor can only equal
other such windows, which is checked by counting 128-bit digests of their words.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, table
from .wordhash import Words, mix

WINDOW, GRAM, BLOCK = 35, 10, 2048
_U = np.uint64


def _blocks(texts: DataFrame, window: int, size: int) -> DataFrame:
    """Blocks (tk, no, text) of rows (tk, text); texts shorter than a window have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            data, which, number, out = words.raw.tobytes(), [], [], []
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                for no in range(max(0, -(-(b - a - window + 1) // size))):
                    last = min(a + (no + 1) * size + window - 1, b) - 1
                    which.append(i)
                    number.append(no)
                    out.append(data[words.start[a + no * size] : words.end[last]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(number, pa.int32()), pa.array(out, pa.binary()).cast(pa.string())], ["tk", "no", "text"])

    return texts.mapInArrow(run, "tk string, no int, text string")


def _anchors(blocks: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (anchor, bid, pos, low, high): the windows low to high have their anchor at pos."""
    reach = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            grams = mix(words.runs(gram))
            n = np.diff(words.first)
            starts = np.repeat(words.first[:-1], np.maximum(n - window + 1, 0)) if len(n) else np.zeros(0, np.int64)
            count = np.maximum(n - window + 1, 0)
            starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
            block = np.repeat(np.arange(len(n)), count)
            least = np.zeros(len(starts), np.int64)
            view = np.lib.stride_tricks.sliding_window_view(grams, reach) if len(grams) >= reach else np.zeros((0, reach), _U)
            for i in range(0, len(starts), 1 << 16):
                part = starts[i : i + (1 << 16)]
                least[i : i + (1 << 16)] = part + view[part].argmin(1)
            new = np.ones(len(starts), bool)
            new[1:] = (least[1:] != least[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(new)
            until = np.append(at[1:], len(starts)) - 1
            base = words.first[:-1][block[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[least[at]].view(np.int64)), batch.column(0).take(pa.array(block[at])), *(pa.array((x - base).astype(np.int32)) for x in (least[at], starts[at], starts[until]))], ["anchor", "bid", "pos", "low", "high"]
            )

    return blocks.mapInArrow(run, "anchor long, bid long, pos int, low int, high int")


def _equal_runs(d: Words, r: Words, d0: int, r0: int, n: int, least: int) -> tuple[list[tuple[int, int]], bool]:
    """Runs (from, end) of ``least`` or more equal words of d from d0 on and r from r0 on, n words each,
    as long as can be; and whether all that have equal hashes are.

    Words of equal hash count as equal only if the run's bytes are.
    """
    same = np.zeros(n + 2, np.int8)
    same[1:-1] = d.hash[d0 : d0 + n] == r.hash[r0 : r0 + n]
    edges = (same[1:] != same[:-1]).nonzero()[0]
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    out, sure = [], True
    for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        if d.text(d0 + a, d0 + b) == r.text(r0 + a, r0 + b):
            out.append((a, b))
            continue
        at, sure = a, False
        for i in range(a, b + 1):
            if i == b or d.word(d0 + i) != r.word(r0 + i):
                out += [(at, i)] if i - at >= least else []
                at = i + 1
    return out, sure


def parse(matches: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """Greedy factors (from, end, match) of a block of ``length`` words, left to right: at each
    word the match (from, end) that holds it and reaches farthest, or no match (-1) as far as
    there is none."""
    order = sorted(range(len(matches)), key=lambda m: matches[m][0])
    out, at, turn, best = [], 0, 0, -1
    while at < length:
        while turn < len(order) and matches[order[turn]][0] <= at:
            if best < 0 or matches[order[turn]][1] > matches[best][1]:
                best = order[turn]
            turn += 1
        if best >= 0 and matches[best][1] > at:
            out.append((at, matches[best][1], best))
        else:
            out.append((at, matches[order[turn]][0] if turn < len(order) else length, -1))
        at = out[-1][1]
    return out


def _spans(matches: list[tuple[int, int]], factors: list[tuple[int, int, int]], window: int) -> list[tuple[int, int]]:
    """Duplicate spans: factors of a window's length, and at each boundary of factors the
    matches of that length that reach over it."""
    out = [(a, b) for a, b, m in factors if m >= 0 and b - a >= window]
    bounds = [a for a, _, _ in factors[1:]]
    for a, b in matches:
        if b - a >= window and bisect_right(bounds, a) < bisect_left(bounds, b):
            out.append((a, b))
    return out


def _factors(blocks: DataFrame, window: int) -> DataFrame:
    """Factor blocks (d, d_text, refs: array of (r, anchors, r_text)) against all their
    reference blocks: rows of kind 0 are duplicate spans (bid, a, b) of a block or of a
    reference, rows of kind 1 windows (bid, a, b, digest) that differ from the index's
    place of their anchor. Matches shorter than a window can't become spans and are left
    to the literals between the factors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column(2).flatten()
            d_words, r_words = Words(batch.column(1)), Words(refs.field(2))
            d_ids, r_ids = batch.column(0).to_numpy(zero_copy_only=False), refs.field(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(d_ids)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))  # of each reference
            marks = refs.field(1).flatten()
            ref = np.repeat(np.arange(len(r_ids)), refs.field(1).value_lengths().to_numpy(zero_copy_only=False))  # of each anchor
            shift, low, high = (marks.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            # All windows of all anchors at once: which are those of the index's place?
            n = high - low + 1
            own = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + low[own]
            d_at, place = d_words.first[row[ref[own]]] + at, at + shift[own]
            inside = (place >= 0) & (place + window <= np.diff(r_words.first)[ref[own]])
            equal = np.zeros(len(own), bool)
            equal[inside] = d_words.runs(window)[d_at[inside]] == r_words.runs(window)[(r_words.first[ref[own]] + place)[inside]]
            matches: dict[int, list[tuple[int, int]]] = {}
            found: list[tuple[int, int, int]] = []  # spans: id, from, end
            # Matches reach along a diagonal as far as words agree.
            held = np.flatnonzero(equal)
            lines, line = np.unique(ref[own[held]] << 32 | shift[own[held]] + (1 << 31), return_inverse=True)
            starts, ends, sizes, r_sizes = d_words.first.tolist(), r_words.first.tolist(), np.diff(d_words.first).tolist(), np.diff(r_words.first).tolist()
            for k, (j, diagonal) in enumerate(zip((lines >> 32).tolist(), ((lines & 0xFFFFFFFF) - (1 << 31)).tolist(), strict=True)):
                i = int(row[j])
                begin = max(0, -diagonal)
                runs, sure = _equal_runs(d_words, r_words, starts[i] + begin, ends[j] + begin + diagonal, min(sizes[i], r_sizes[j] - diagonal) - begin, window)
                runs = [(a + begin, b + begin) for a, b in runs]
                matches.setdefault(i, []).extend(runs)
                found += [(int(r_ids[j]), a + diagonal, b + diagonal) for a, b in runs]
                if not sure:  # windows that were equal by hash alone
                    mine = held[line == k]
                    equal[[m for m in mine.tolist() if not any(a <= at[m] and at[m] + window <= b for a, b in runs)]] = False
            for i, own_matches in matches.items():
                size = int(d_words.first[i + 1] - d_words.first[i])
                found += [(int(d_ids[i]), a, b) for a, b in _spans(own_matches, parse(own_matches, size), window)]
            open_ = np.flatnonzero(~equal)
            data, begins = d_words.packed
            digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(begins[d_at[open_]].tolist(), begins[d_at[open_] + window].tolist(), strict=True)]
            ids, a, b = (np.array([f[i] for f in found], np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1], np.int32), [len(found), len(open_)])), pa.array(np.concatenate([ids, d_ids[row[ref[own[open_]]]]])), pa.array(np.concatenate([a, at[open_]]).astype(np.int32)),
                    pa.array(np.concatenate([b, at[open_] + window]).astype(np.int32)), pa.array([None] * len(found) + digests, pa.binary()),
                ], ["kind", "bid", "a", "b", "digest"],
            )

    return blocks.select("d", "d_text", "refs").mapInArrow(run, "kind int, bid long, a int, b int, digest binary")


def duplicate_spans(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Return tk (md5 of the text) and spans (array of first word, end word) of the words
    that lie in a window which also starts elsewhere; texts without any are left out."""
    bound_batches(docs.sparkSession, rows=1000, mb=4)
    texts = docs.select(F.md5(F.coalesce(text_col, F.lit("")).cast("binary")).alias("tk"), F.coalesce(text_col, F.lit("")).alias("text"))
    pieces = _blocks(texts, window, block).withColumn("bk", F.md5(F.col("text").cast("binary")))
    unique = pieces.groupBy("bk").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    unique = materialize(unique.withColumn("bid", F.monotonically_increasing_id()), "blocks")
    anchors = materialize(_anchors(unique.select("bid", "text"), window, gram), "anchors")
    # first() of all columns takes them from one row; any occurrence will do as reference.
    index = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.first("bid").alias("r"), F.first("pos").alias("r_pos")).where("n > 1").drop("n"), "index")
    found = anchors.join(index, "anchor").where("bid <> r or pos <> r_pos")
    pairs = materialize(found.groupBy(F.col("bid").alias("d"), "r").agg(F.collect_list(F.struct("pos", (F.col("r_pos") - F.col("pos")).alias("shift"), "low", "high")).alias("anchors")), "pairs")
    # A block has no more references than windows, so its references fit in one row.
    with_r = pairs.join(unique.select(F.col("bid").alias("r"), F.col("text").alias("r_text")), "r").select("d", F.struct("r", "anchors", "r_text").alias("ref"))
    with_d = with_r.join(unique.select(F.col("bid").alias("d"), F.col("text").alias("d_text")), "d")
    parsed = materialize(_factors(with_d.groupBy("d").agg(F.first("d_text").alias("d_text"), F.collect_list("ref").alias("refs")), window), "factors")
    open_ = parsed.where("kind = 1").select("bid", "a", "b", "digest")
    again = materialize(open_.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    spans = parsed.where("kind = 0").select("bid", "a", "b").union(open_.join(again, "digest").select("bid", "a", "b"))
    whole = unique.where("copies > 1").select("bid", F.lit(0).alias("a"), F.lit(2**31 - 1).alias("b"))
    by_block = spans.union(whole).groupBy("bid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    by_key = materialize(unique.select("bid", "bk").join(by_block, "bid").select("bk", merged("spans").alias("spans")), "spans")
    at = pieces.select("tk", "no", "bk").distinct().join(by_key, "bk")
    limit = F.lit(block + window - 1)
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("no") * block).alias("a"), (F.least(s["b"], limit) + F.col("no") * block).alias("b")))
    return at.groupBy("tk").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def merged(spans: str):
    """Union of overlapping spans of an array column."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when(F.size(done) == 0, F.array(s)).when(last["b"] >= s["a"], grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(F.col(spans)), none, add)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (words joined by a space).

    Each word that lies in a window of ``window`` words of one text which also starts
    anywhere else (same text included) is removed; windows are judged on the input.
    Words are taken unchanged. A null text has no words; texts shorter than a window
    lose none; repeated rows and copies are occurrences like any other; an empty
    table gives no rows; a null id is kept as it is; other columns are not read.
    """
    spans = materialize(duplicate_spans(docs, text_col, window, **how), "document_spans")
    bound_batches(docs.sparkSession, rows=1000, mb=4)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tk", F.md5(F.col("text").cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(texts.cast(pa.binary()).to_pylist(), lists.to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if spans:
                    stay = np.ones(len(words), bool)
                    for s in spans:
                        stay[s["a"] : s["b"]] = False
                    words = [words[i] for i in np.flatnonzero(stay)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.join(spans, "tk", "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, words[i] AS word, i, len(words) - i >= 34 AS whole, words FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
win AS (SELECT doc_id, word, i, CASE WHEN whole THEN md5(array_to_string(list_slice(words, i, i + 34), ' ')) END AS k FROM word),
often AS (SELECT k FROM win WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
marked AS (
  SELECT doc_id, word, i, coalesce(max(CASE WHEN often.k IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 35, false) AS gone
  FROM win LEFT JOIN often ON win.k = often.k),
done AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN done USING (doc_id)
"""
