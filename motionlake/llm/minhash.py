"""Near-duplicate components by one-permutation MinHash.

One hash of each word shingle fills ``bins`` bins with their least values; empty
bins borrow from filled ones by optimal densification (a fresh hash of bin and
attempt picks the lender). Bands of rows of the signature are buckets; within a
bucket only star-shaped edges from a centre are candidates, so their number grows
with the members and not with their square. Each candidate is confirmed on the full
shingle sets. Because a star can hide a link between two members, the members of
buckets that have not all met in one component are settled exactly: two sets of
enough similarity share one of their rarest shingles, so these few are the keys of
finer groups, which get further centres until every two members that could be
linked are in one component or were compared. Bands are taken in waves: links of one
wave are joined before the next, which compares only what is still apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, table
from .graph import merged
from .wordhash import Words, mix

BINS, ROWS = 256, 5  # 51 bands: a pair of similarity 0.75 is missed once in a million
PERCENT, SHINGLE = 75, 5
WAVES = (2, 8)  # bands whose links are joined before the next ones are looked at
_FEW = 8
_U = np.uint64
_borrow: list[np.ndarray] = []


def shingle_places(words: Words, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of document i of a batch, and a word at which each begins."""
    a, b = words.first[i], words.first[i + 1]
    if b - a >= k:
        hashes, at = np.unique(words.runs(k)[a : b - k + 1], return_index=True)
        return hashes, at + a
    whole = [int.from_bytes(hashlib.blake2b(words.text(a, b), digest_size=8).digest(), "little")] if b > a else []
    return np.array(whole, _U), np.array([a] * len(whole), np.int64)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a batch."""
    runs, out = words.runs(k), []
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        out.append(np.unique(runs[a : b - k + 1]) if b - a >= k else shingle_places(words, i, k)[0])
    return out


def set_key(words: Words, i: int, k: int, hashes: np.ndarray) -> bytes | None:
    """128 bits that equal sets have in common; None for an empty set. Sets of a few
    shingles, whose hashes alone could be equal by chance, add the shingles' words."""
    if not len(hashes):
        return None
    said = hashlib.blake2b(hashes.tobytes(), digest_size=16)
    if len(hashes) <= _FEW:
        last = words.first[i + 1]
        for at in shingle_places(words, i, k)[1].tolist():
            said.update(words.text(at, min(at + k, last)))
    return said.digest()


def common_shingles(x: Words, i: int, y: Words, j: int, k: int) -> int:
    """Number of distinct shingles that two documents have in common; those of equal
    hash are compared word by word."""
    (hx, ax), (hy, ay) = shingle_places(x, i, k), shingle_places(y, j, k)
    _, px, py = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    ax, ay = ax[px], ay[py]
    order = np.argsort(ax)
    ax, ay = ax[order], ay[order]
    cut = np.flatnonzero((np.diff(ax) != 1) | (np.diff(ay) != 1)) + 1
    found, ends = 0, (x.first[i + 1], y.first[j + 1])

    def same(a: int, b: int, n: int) -> bool:
        return x.text(a, min(a + n + k - 1, ends[0])) == y.text(b, min(b + n + k - 1, ends[1]))

    for a, b in zip(np.split(ax, cut), np.split(ay, cut), strict=True):  # runs of neighbours at once
        if len(a):
            found += len(a) if same(a[0], b[0], len(a)) else sum(same(p, q, 1) for p, q in zip(a, b, strict=True))
    return found


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Least hash of each bin (bins are the hash's top bits), densified; hashes: sorted, not empty."""
    edges = np.arange(bins, dtype=_U) << _U(64 - bins.bit_length() + 1)
    at = np.minimum(np.searchsorted(hashes, edges), len(hashes) - 1)
    least = hashes[at]
    filled = (least >> _U(64 - bins.bit_length() + 1)) == np.arange(bins, dtype=_U)
    lender, turn = np.where(filled, np.arange(bins), -1), 0
    while (need := np.flatnonzero(lender < 0)).size:
        if turn == len(_borrow):
            tries = (np.arange(64, dtype=_U) + _U(64 * turn + 1))[:, None] * _U(0x9E3779B97F4A7C15)
            _borrow.append((mix(tries ^ mix(np.arange(bins, dtype=_U)[None, :])) % _U(bins)).astype(np.int64))
        picks = _borrow[turn][:, need]
        ok = filled[picks]
        first = ok.argmax(0)
        found = ok[first, np.arange(len(need))]
        lender[need[found]] = picks[first, np.arange(len(need))][found]
        turn += 1
    return least[lender]


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values."""
    n = sig.shape[-1] // rows
    parts = sig[..., : n * rows].reshape(*sig.shape[:-1], n, rows)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=_U) * _U(0xD1342543DE82EF95), parts.shape[:-1]).copy()
    for i in range(rows):
        key = mix(key ^ parts[..., i]) + _U(i)
    return key


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """Return doc_id, text_key (md5 of the text), n_shingles, set_key (16 bytes, null if empty) and bands."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(2), lower=True)
            sets = shingle_sets(words, k)
            keys = [set_key(words, i, k, s) for i, s in enumerate(sets)]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = np.zeros((0, bins // rows), _U)
            if full:
                bands = band_keys(np.stack([signature(sets[i], bins) for i in full]), rows)
            sizes = np.array([bands.shape[1] if len(s) else 0 for s in sets], np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key string, n_shingles long, set_key binary, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (ca, cb) of those ``pairs`` (a, b, ca, cb) whose full shingle sets share
    ``percent`` of their union; texts: rows (node, text). Links repeat once."""
    firsts = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = firsts.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("ca", "cb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (Words(batch.column(i), lower=True) for i in (2, 3))
            ok = []
            for i, (p, q) in enumerate(zip(shingle_sets(x, k), shingle_sets(y, k), strict=True)):
                at = np.searchsorted(q, p)
                n = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                enough = lambda n, size=len(p) + len(q): n > 0 and 100 * n >= percent * (size - n)
                ok.append(enough(n) and enough(common_shingles(x, i, y, i, k)))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "ca long, cb long").distinct()


def rarest_keys(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (key, node, size, pos, most, index, odd): each set's rarest shingles that others have too.

    Two sets are linked if their common part is at least ``percent / (100 + percent)``
    of both sizes together. So the first common shingle in order of rarity stands at a
    place ``pos`` of each set from which on that much is left. That bounds the other
    set's size (``most``), the places to look at, and, for the smaller set of a pair,
    the places more tightly (``index``). Any fixed order is right; by rarity, keys are
    the most telling. ``odd`` counts the shingles that no other set has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(Words(batch.column(1), lower=True), k)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            at = pa.array(np.repeat(np.arange(len(sets)), size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.repeat(size, size)), pa.array(np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64))], ["node", "size", "key"])

    rows = materialize(texts.select("node", "text").mapInArrow(run, "node long, size long, key long").distinct(), "shingles")
    often = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "frequencies")
    named = rows.join(often, "key", "left").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "key"))).alias("keys"), F.count_if(F.col("n").isNull()).alias("odd"))
    probe = f"size - (size * {percent} + 99) div 100 + 1"
    first = named.select("node", "size", "odd", F.posexplode(F.slice("keys", F.lit(1), F.expr(f"cast({probe} as int)"))).alias("pos", "k")).where("k.n > 1")
    most = F.expr(f"(size - pos) * {100 + percent} div {percent} - size")
    placed = materialize(first.select("k.key", "node", "size", "pos", most.alias("most"), (most >= F.col("size")).alias("index"), "odd"), "keys")
    least = materialize(placed.groupBy("key").agg(F.min("size").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    return placed.join(least, "key").where("most >= least").drop("least")


def settle(keys: DataFrame, texts: DataFrame, tested: DataFrame, comp: DataFrame | None, k: int, percent: int) -> DataFrame:
    """Components after all links within the groups of ``keys`` are found.

    Each turn chooses more centres among a group's index members, the least odd
    first, compares them with the members of other components, and closes groups that
    lie in one component or have no such member left.
    """
    left, centres = materialize(keys, "keys"), 4
    while True:
        now = materialize(_named(left, comp), "open")
        open_ = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("index").alias("some")).where("c0 < c1 and some").select("key")
        now = materialize(now.join(materialize(open_, "open_keys"), "key", "left_semi"), "open")
        if now.isEmpty():
            return comp
        chosen = now.where("index").groupBy("key", F.pmod(F.xxhash64("node"), F.lit(centres)).alias("slice")).agg(F.min(F.struct("odd", "node", "comp", "size", "most")).alias("c"))
        chosen = materialize(chosen.select("key", *(F.col(f"c.{x}").alias(f"centre_{x}") for x in ("node", "comp", "size", "most"))), "centres")
        new = now.join(chosen, "key").where("comp <> centre_comp and most >= centre_size and centre_most >= size")
        new = new.where(f"100 * least(size, centre_size) >= {percent} * greatest(size, centre_size)")
        comp, tested = _joined(new.selectExpr("node", "comp", "centre_node as centre", "centre_comp"), tested, comp, texts, k, percent)
        left = materialize(now.drop("comp").join(chosen.select("key", F.col("centre_node").alias("node")), ["key", "node"], "left_anti").select(*left.columns), "left")
        centres *= 4


def _named(rows: DataFrame, comp: DataFrame | None, col: str = "node", name: str = "comp") -> DataFrame:
    """``rows`` with the component of ``col``, a node's own number where it has none yet."""
    if comp is None:
        return rows.withColumn(name, F.col(col))
    known = comp.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return rows.join(known, F.col(col) == F.col("_node"), "left").withColumn(name, F.coalesce("_comp", col)).drop("_node", "_comp")


def _joined(pairs: DataFrame, tested: DataFrame | None, comp: DataFrame | None, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Components and tested pairs after ``pairs`` (node, comp, centre, centre_comp), of
    which each is compared once."""
    swapped = F.col("node") < F.col("centre")
    new = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"), F.when(swapped, F.col("comp")).otherwise(F.col("centre_comp")).alias("ca"), F.when(swapped, F.col("centre_comp")).otherwise(F.col("comp")).alias("cb")).distinct()
    new = materialize(new if tested is None else new.join(tested, ["a", "b"], "left_anti"), "candidates")
    if new.isEmpty():
        return comp, tested
    tested = new.select("a", "b") if tested is None else materialize(tested.union(new.select("a", "b")), "tested")
    links = materialize(confirm(new, texts, k, percent), "links")
    return (comp if links.isEmpty() else merged(comp, links)), tested


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, bins: int, rows: int) -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, and first: the smallest
    (doc_id, text_key) of its component; null where it is linked with nothing."""
    bound_batches(docs.sparkSession)
    sketched = materialize(sketches(docs, id_col, text_col, k, bins, rows), "sketches")
    # Equal sets are one node; nodes have numbers of their own, as one id may name several texts.
    sets = sketched.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("c"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(buckets.select("bucket", "n", F.col("c.node").alias("centre"), F.col("c.n_shingles").alias("centre_size")), "buckets")
    members = materialize(members.join(buckets, "bucket").select("band", "bucket", "node", "n_shingles", "n", "centre", "centre_size"), "members")
    some = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first.*")
    own = docs.select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col).cast("binary")).alias("text_key"), F.col(text_col).alias("text"))
    texts = materialize(own.join(some, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "texts")
    comp, tested, bounds = None, None, [*(w for w in WAVES if w < bins // rows), bins // rows]
    for low, high in zip([0, *bounds], bounds, strict=False):
        wave = members.where((F.col("band") >= low) & (F.col("band") < high)).where("node <> centre").where(f"100 * least(n_shingles, centre_size) >= {percent} * greatest(n_shingles, centre_size)")
        pairs = _named(_named(wave.select("node", "centre").distinct(), comp), comp, "centre", "centre_comp").where("comp <> centre_comp")
        comp, tested = _joined(pairs, tested, comp, texts, k, percent)
    # Members of buckets of three or more that are in several components.
    at = materialize(_named(members.where("n > 2").select("bucket", "node"), comp), "named")
    open_ = materialize(at.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket"), "open")
    unsettled = materialize(at.join(open_, "bucket", "left_semi").select("node").distinct(), "unsettled")
    if not unsettled.isEmpty():
        theirs = materialize(texts.join(unsettled, "node", "left_semi"), "texts")
        comp = settle(rarest_keys(theirs, k, percent), theirs, tested, comp, k, percent)
    found = materialize(_named(nodes.select("set_key", "first", "node"), comp).drop("node"), "named")
    first = found.groupBy("comp").agg(F.min("first").alias("least"))
    named = materialize(found.join(first, "comp").select("set_key", F.col("least").alias("first")), "classes")
    out = sketched.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z only; texts with fewer than k words are one
    shingle; null, empty and blank texts have none and are linked with nothing.
    component_id is the smallest id that confirmed links reach, and kept says that
    it is the row's own. The id is a whole number; repeated rows get the same result,
    and several texts under one id are linked each by itself. Rows with a null id are
    never linked: their component_id is null and they are kept. An empty table gives
    no rows; other columns are not read.
    """
    out = _classes(docs, id_col, text_col, k, percent, bins, rows)
    own = F.coalesce("first.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, all columns.

    It is the one of the smallest id and, among several texts of that id, of the least
    md5; a row that is repeated as a whole counts as one document. Rows with a null id
    and rows whose text is null or has no words are linked with nothing and stay. An
    empty table stays empty; other columns, whatever their names, are passed on.
    """
    out = _classes(docs, id_col, text_col, k, percent, bins, rows)
    gone = out.where(F.col("first.doc_id").isNotNull() & (F.col("first") != F.struct("doc_id", "text_key"))).select("doc_id", "text_key").distinct()
    gone = materialize(gone, "gone")
    return docs.join(gone, (docs[id_col] == gone["doc_id"]) & (F.md5(docs[text_col].cast("binary")) == gone["text_key"]), "left_anti")


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(words, i, i + 4), ' ')) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (SELECT a AS node, a AS other FROM link UNION SELECT node, b FROM reach JOIN link ON other = a),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON node = d.doc_id
"""
