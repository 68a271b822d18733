"""The prefix trie of rebuilt conversations, as succinct level-order tries by shard.

A node is a distinct sequence of first turns, known by its depth and a 128-bit prefix
hash. Turns make nodes by one grouping. A node below which at most ``light`` turns lie
roots a shard: its subtree is bounded, and one task lays out several shards as one
forest in level order, a LOUDS bitvector with label arrays, whose parents are found by
rank and select and whose rollups go up level by level. The few nodes above, which may
hold a third of all conversations each, are merged apart from the shards' totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Turns below a node up to which its subtree is a shard, nodes of a forest, ids of a piece of text.
LIGHT, FOREST, PIECE = 1024, 1 << 15, 4096
KEY = ["depth", "k1", "k2"]
_OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, k1 long, k2 long"
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "k1", "k2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, n) and their turns (conv_id, n, depth, role, text).

    With h the crc32 of the decimal id modulo ``most``, the first h turns are those of
    the conversation whose id is the next multiple of ``family`` towards zero; its own
    turns after its first h follow. ``n`` is the number of turns, perhaps 0.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    placed = materialize(rows.select("conv_id", "role", "text", place.cast("long").alias("place")), "placed")
    counted = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    ids = counted.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = counted.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    ids = ids.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    ids = materialize(ids, "ids")
    heads = placed.where((F.col("conv_id") % family == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "role", "text")
    given = ids.join(heads, "base").where("depth <= h").select("conv_id", "n", "depth", "role", "text")
    own = placed.join(ids, "conv_id").where("place > h").select("conv_id", "n", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "role", "text")
    return ids.select("conv_id", "n"), given.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Of each turn conv_id, n, depth, words, the hash k1, k2 of the turns up to it and p1, p2 of those before."""
    named = [F.col("depth"), F.length("role"), F.col("role"), F.col("text")]
    hashed = turns.select("conv_id", "n", "depth", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.xxhash64(F.lit("k1"), *named).alias("h1"), F.xxhash64(F.lit("k2"), *named).alias("h2"))
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = hashed.withColumns({k: F.bit_xor(h).over(upto) for k, h in (("k1", "h1"), ("k2", "h2"))})
    return chained.select("conv_id", "n", *KEY, "words", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"))


class Louds:
    """A forest in level order. Node i is the i-th one bit; the bits are, for a root above
    all and then for each node, a one for each child and a zero."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        self.ones, self.zeros = np.flatnonzero(self.bits), np.flatnonzero(~self.bits)

    @classmethod
    def of(cls, parent: np.ndarray) -> Louds:
        """From each node's parent in level order, -1 for roots; parents rise."""
        children = np.bincount(parent + 1, minlength=len(parent) + 1)
        bits = np.ones(len(parent) + len(children), bool)
        bits[np.cumsum(children + 1) - 1] = False
        return cls(bits)

    @classmethod
    def read(cls, data: bytes, nodes: int) -> Louds:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8), count=2 * nodes + 1))

    def write(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def parents(self) -> np.ndarray:
        """rank0(select1(i)) counts the root above all as node 0."""
        return self.ones - np.arange(len(self.ones)) - 1

    def children(self) -> np.ndarray:
        """The number of children of each node: ones between two zeros."""
        return np.diff(self.zeros) - 1

    def levels(self) -> list[tuple[int, int]]:
        """Where each level begins and ends: the next holds the children of the last."""
        found, begin, end = [], 0, int(self.zeros[0])
        while begin < end:
            found.append((begin, end))
            begin, end = end, int(self.zeros[end] - end)
        return found


def level_order(root: np.ndarray, depth: np.ndarray, key: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes in level order and each one's parent in it, -1 for the roots.

    ``key`` and ``above`` are (n, 2) hashes of a node's and of its parent's turns,
    ``root`` is the depth of the node's shard root.
    """
    level, order, parents, done = depth - root, [], [], 0
    last = before = None
    triple = np.dtype([("d", np.int64), ("a", np.int64), ("b", np.int64)])

    def packed(d, k):
        out = np.empty(len(d), triple)
        out["d"], out["a"], out["b"] = d, k[:, 0], k[:, 1]
        return out

    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
    for begin, end in zip(cuts, cuts[1:]):
        here = by_level[begin:end]
        if last is None:
            parent = np.full(len(here), -1)
        else:
            parent = before[np.searchsorted(last, packed(depth[here] - 1, above[here]))]
        turn = np.lexsort((key[here, 1], key[here, 0], parent))
        here, parent = here[turn], parent[turn]
        order.append(here)
        parents.append(parent)
        own = packed(depth[here], key[here])
        sort = np.argsort(own, kind="stable")
        last, before = own[sort], sort + done
        done += len(here)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(order), np.concatenate(parents)) if order else (empty, empty)


#: A forest: its bits, and arrays in level order as bytes.
_ARRAYS = ["conv_id", "depth", "n_convs", "words", "k1", "k2"]
_FOREST = ", ".join(["n int", "bits binary", *(f"{a} binary" for a in _ARRAYS)])


def forests(light: DataFrame, nodes: int = FOREST) -> DataFrame:
    """Shards (nodes with s_depth, s1, s2 of their shard root) as forests of about ``nodes`` nodes."""
    cols = ["s_depth", "s1", "s2", "depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "words"]

    def forest(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        order, parent = level_order(c["s_depth"], c["depth"], np.stack([c["k1"], c["k2"]], 1), np.stack([c["p1"], c["p2"]], 1))
        row = [pa.array([len(order)], pa.int32()), pa.array([Louds.of(parent).write()], pa.binary())]
        return pa.RecordBatch.from_arrays([*row, *(pa.array([c[a][order].tobytes()], pa.binary()) for a in _ARRAYS)], ["n", "bits", *_ARRAYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(cols)}
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in cols}
            if len(held["depth"]) >= nodes:  # whole shards only; the last one may go on in the next batch
                same = np.ones(len(held["depth"]), bool)
                for n in cols[:3]:
                    same &= held[n] == held[n][-1]
                whole = len(same) - int(same.sum())
                if whole:
                    yield forest({n: v[:whole] for n, v in held.items()})
                    held = {n: v[whole:] for n, v in held.items()}
        if held is not None and len(held["depth"]):
            yield forest(held)

    return light.select(*cols).repartition("s_depth", "s1", "s2").sortWithinPartitions("s_depth", "s1", "s2").mapInArrow(run, _FOREST)


def rollups(shards: DataFrame) -> DataFrame:
    """The nodes of forests with children, and leaves and saved tokens of their subtrees.

    Sums go from the last level to the first, each level's into its parents; roots'
    parent_conv_id is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                trie, c = Louds.read(r["bits"], r["n"]), {a: np.frombuffer(r[a], np.int64) for a in _ARRAYS}
                parent, children = trie.parents(), trie.children()
                leaves, saved = (children == 0).astype(np.int64), (c["n_convs"] - 1) * c["words"]
                for begin, end in reversed(trie.levels()[1:]):
                    np.add.at(leaves, parent[begin:end], leaves[begin:end])
                    np.add.at(saved, parent[begin:end], saved[begin:end])
                up = pa.array(c["conv_id"][parent], pa.int64(), mask=parent < 0)
                cols = [c["conv_id"], c["depth"], up, c["n_convs"], children, leaves, saved, c["k1"], c["k2"]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in cols], _NODE)

    return shards.mapInArrow(run, _OUT)


def id_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """Per key (depth, k1, k2) the sha256 of its conv_ids, ascending and joined by commas.

    Ids are joined to texts of at most ``piece`` ids each; a digest, which has to take
    its bytes in order, is fed text by text, so no task holds a group.
    """
    parts = ends.groupBy(*KEY, F.floor(F.col("conv_id") / piece).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], [*KEY, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, digest.hexdigest())], [*KEY, "ends_sha256"])

    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, light: int = LIGHT, nodes: int = FOREST, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, root included.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Null roles and texts count as empty;
    turns of equal number are ordered by role and text, and a repeated row is a repeated
    turn; rows with a null conv_id belong to no conversation; an empty table gives no
    rows; other columns are not read. Equal prefixes are told by 128-bit hashes.
    ``light``, ``nodes`` and ``piece`` change the plan, not the result.
    """
    ids, turns = rebuilt(conversations)
    turns = materialize(prefixes(turns), "turns")
    one = {"p1": F.min("p1"), "p2": F.min("p2"), "words": F.min("words")}
    found = turns.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("below"), *(f.alias(n) for n, f in one.items()))
    found = materialize(found, "nodes")
    heavy = materialize(found.where(F.col("below") > light), "heavy")
    # The smallest member of a node is that of all nodes below which hold it: a conversation owns one
    # stretch of its own path, and the first light node of that path is the root of the stretch's shard.
    owned = materialize(turns.join(found.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", *KEY), "owned")
    path = materialize(owned.join(heavy.select(*KEY), KEY).select("conv_id", *KEY), "path")
    deep = path.groupBy("conv_id").agg(F.max("depth").alias("h"))
    roots = owned.join(deep, "conv_id", "left").where(F.col("depth") == F.coalesce("h", F.lit(0)) + 1)
    roots = roots.select("conv_id", F.col("depth").alias("s_depth"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    shards = materialize(forests(found.where(F.col("below") <= light).join(roots, "conv_id"), nodes), "forests")
    below = materialize(rollups(shards), "below")
    # Upper levels: shard totals and the heavy nodes' own, summed along each owner's path and then by node.
    hung = found.select(*KEY, "p1", "p2").join(below.where("parent_conv_id is null"), KEY)
    tops = materialize(hung.select(*KEY, "p1", "p2", "conv_id", "n_leaves", "saved_tokens"), "tops")
    up = lambda df: df.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    kids = materialize(up(tops).unionByName(up(heavy)).groupBy(*KEY).agg(F.count("*").alias("n_children")), "kids")
    own = heavy.join(kids, KEY, "left").select(*KEY, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"))
    own = materialize(own.withColumn("own_leaves", (F.col("n_children") == 0).cast("long")), "own")
    items = tops.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    items = materialize(items.unionByName(own.select("conv_id", "depth", F.col("own_leaves").alias("leaves"), F.col("own_saved").alias("saved"))).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "items")
    from_below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = path.join(items, ["conv_id", "depth"], "left").withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(from_below) for c in ("leaves", "saved")})
    summed = along.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # A parent of a heavy node or of a shard root is heavy or the root of all.
    first = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    parents = heavy.select(*KEY, F.col("conv_id").alias("parent_conv_id")).unionByName(first.select(*(F.lit(0).cast("long").alias(k) for k in KEY), F.col("conv_id").alias("parent_conv_id")))
    parents = materialize(parents, "parents")
    below_key = lambda df: df.select("conv_id", (F.col("depth") - 1).alias("up_depth"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), *KEY)
    named = below_key(tops).unionByName(below_key(heavy)).join(parents.select(F.col("depth").alias("up_depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), "parent_conv_id"), ["up_depth", "u1", "u2"])
    named = materialize(named.select(*KEY, "parent_conv_id"), "parents_of")
    upper = own.join(summed, KEY).join(named, KEY).select(*_NODE)
    hanging = below.where("parent_conv_id is null").drop("parent_conv_id").join(named, KEY).select(*_NODE)
    whole = items.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    top = kids.where("depth = 0").select(F.col("n_children").alias("kids"))
    root = first.crossJoin(whole).join(top, F.lit(True), "left")  # one row each
    zero = F.lit(0).cast("long")
    root = root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("kids", zero).alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), zero.alias("k1"), zero.alias("k2"))
    every = below.where("parent_conv_id is not null").select(*_NODE).unionByName(hanging).unionByName(upper).unionByName(root)
    ends = turns.where("depth = n").select("conv_id", *KEY).unionByName(ids.where("n = 0").select("conv_id", *(zero.alias(k) for k in KEY)))
    digests = materialize(id_digests(ends, piece), "digests")
    return every.join(digests, KEY, "left").select(*_NODE[:-2], F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The crc32 of a number's digits, bit by bit; 3988292384 is the reversed polynomial.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))))"""
OP11_SQL = rf"""
WITH placed AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
counted AS (SELECT conv_id, count(*) AS own FROM placed GROUP BY conv_id),
ids AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM counted),
sized AS MATERIALIZED (SELECT i.conv_id, base, h, least(h, coalesce(b.own, 0)) AS taken
  FROM ids i LEFT JOIN counted b ON b.conv_id = i.base),
turns AS (
  SELECT s.conv_id, p.place AS d, role, text FROM sized s JOIN placed p ON p.conv_id = s.base AND p.place <= h
  UNION ALL SELECT s.conv_id, taken + place - h, role, text FROM sized s JOIN placed p ON p.conv_id = s.conv_id AND p.place > h),
chained AS MATERIALIZED (
  SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         sha256(string_agg(sha256(length(role) || ':' || role || text), '' ) OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM turns),
linked AS MATERIALIZED (SELECT *, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY d), '') AS p,
         d = max(d) OVER (PARTITION BY conv_id) AS final FROM chained),
nodes AS MATERIALIZED (
  SELECT k, any_value(p) AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved
  FROM linked GROUP BY k, d
  UNION ALL SELECT '', NULL, 0, min(conv_id), count(*), 0 FROM ids HAVING count(*) > 0),
kids AS MATERIALIZED (SELECT p AS k, count(*) AS n_children FROM nodes WHERE p IS NOT NULL GROUP BY p),
below AS (
  SELECT a.k, n.saved, (c.k IS NULL)::INT AS leaf FROM nodes n LEFT JOIN kids c ON c.k = n.k
  JOIN (SELECT conv_id, d, k FROM linked UNION ALL SELECT conv_id, 0, '' FROM ids) a ON a.conv_id = n.conv_id AND a.d <= n.depth),
sums AS (SELECT k, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM below GROUP BY k),
ends AS (
  SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (
    SELECT k, conv_id FROM linked WHERE final
    UNION ALL SELECT '', conv_id FROM ids WHERE conv_id NOT IN (SELECT conv_id FROM linked)) GROUP BY k)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.k = n.k LEFT JOIN nodes u ON u.k = n.p LEFT JOIN kids c ON c.k = n.k LEFT JOIN ends e ON e.k = n.k
"""
