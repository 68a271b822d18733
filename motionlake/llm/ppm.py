"""Language-model scores by prediction by partial matching over bytes.

Spark counts all runs of ``order + 1`` bytes of the training texts, and from them
those of shorter runs: the trie of byte contexts. Escape probabilities follow method
D: of n symbols with t distinct ones, t / 2n escape and (2c - 1) / 2n is a symbol's;
symbols of a longer context are excluded from the shorter ones. Since a shorter
context has all symbols of a longer one, what is excluded depends on the last longer
context only, so all masses are tables and texts are scored in vectorised steps. The
counts stay fixed while scoring.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, materialize, table
from .hashindex import HashTable

ORDER, MAX_NODES, SHORT, FREQUENT, LONGEST = 6, 3_000_000, 100_000, 250_000, 64
_PART = 250_000  # keys that a task of resolved() holds
_WORDS, _HELD, _KEYS = 200_000, 1_600_000, 800_000  # what a task holds before it passes counts on
_U = np.uint64


def token_lists(texts: pa.Array) -> list[list[bytes]]:
    """Words of each text, A-Z lower-cased; null counts as empty."""
    return [t.lower().split() for t in texts.cast(pa.binary()).fill_null(b"").to_pylist()]


def context_keys(tokens: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of ``words joined by a space + LF``: it and the ``order`` bytes before
    it as one number; and the number of such bytes of each text. A text is preceded by LFs."""
    pad = b"\n" * order
    texts = [b" ".join(t) for t in tokens]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    n = int(size.sum()) + order * len(texts)
    # Every eight bytes as one big-endian number, read in place; the last is the newest.
    raw = b"\n" * 7 + pad + b"".join(t + b"\n" + pad for t in texts)
    key = np.ndarray((n,), ">u8", raw, order, (1,)).astype(_U) & _U((1 << 8 * (order + 1)) - 1)
    first = np.cumsum(size + order) - size - order
    real = np.zeros(len(key) + 1, np.int8)
    np.add.at(real, first, 1)
    np.add.at(real, first + size, -1)
    return key[np.cumsum(real[:-1], dtype=np.int32) > 0], size


def statistics(docs: DataFrame, train: Column, text_col: str, order: int) -> DataFrame:
    """word or key, and n: how often the training rows have it."""
    bound_batches(docs.sparkSession, rows=500, mb=2)

    def packed(words: Counter, keys: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "key", "n"])
        if keys:
            known, n = merged(keys)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(known), pa.binary()), pa.array(known.view(np.int64)), pa.array(n)], ["word", "key", "n"])

    def merged(keys):
        if len(keys) == 1:
            return keys[0]
        known, place = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        return known, np.bincount(place, np.concatenate([n for _, n in keys]), len(known)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, held = Counter(), [], 0
        for batch in batches:
            tokens = token_lists(batch.column(0))
            for t in tokens:
                words.update(t)
            words[b"\n"] += len(tokens)  # the end of a text; no word has this byte
            known, n = np.unique(context_keys(tokens, order)[0], return_counts=True)
            keys.append((known, n.astype(np.int64)))
            held += len(known)
            if len(words) > _WORDS:
                yield from packed(words, [])
                words = Counter()
            if held > _HELD:
                keys = [merged(keys)]
                held = len(keys[0][0])
            if held > _KEYS and len(keys) == 1:
                yield from packed(Counter(), keys)
                keys, held = [], 0
        yield from packed(words, keys)

    parts = docs.where(train).select(F.col(text_col)).mapInArrow(run, "word binary, key long, n long")
    return materialize(parts.groupBy("word", "key").agg(F.sum("n").alias("n")), "statistics")


@dataclass
class Level:
    """Counts of one order: its nodes (context and symbol as one number) and, where nodes
    are pruned, the true totals of their contexts; sorted by key."""

    nodes: np.ndarray
    n: np.ndarray
    contexts: np.ndarray | None = None
    totals: np.ndarray | None = None


@dataclass
class Trie:
    """By order, hash tables of natural logs: nodes, with n (log(2 n - 1)) and p (the
    probability without exclusion), and contexts, with escape and, for one order below
    with the context's own symbols excluded, rest and escape_rest."""

    order: int
    nodes: list[HashTable]
    contexts: list[HashTable]
    log_unseen: float


def shorter(level: Level, k: int) -> Level:
    """Level k - 1 from a level k that has all its nodes."""
    nodes, place = np.unique(level.nodes & _U((1 << 8 * k) - 1), return_inverse=True)
    return Level(nodes, np.bincount(place, level.n, len(nodes)))


def build_trie(levels: list[Level]) -> Trie:
    """Tables from the levels of order 0, 1, ...; a node's suffix must be in the level below."""
    trie = Trie(len(levels) - 1, [], [], -float(np.log(max(256 - len(levels[0].nodes), 1))))
    grow(trie, levels)
    return trie


def grow(trie: Trie, levels: list[Level], below: Level | None = None, under: tuple | None = None) -> tuple:
    """Add the next orders to the tables; below and under are what this returned for the order before."""
    for level in levels:
        k = len(trie.nodes)
        contexts, place = np.unique(level.nodes >> _U(8), return_inverse=True)
        kept, kinds = np.bincount(place, level.n, len(contexts)), np.bincount(place, minlength=len(contexts))
        totals = kept if level.totals is None else level.totals[np.searchsorted(level.contexts, contexts)].astype(float)
        lost = totals - kept
        columns = {"all": np.log(2 * totals), "escape": np.log((kinds + 2 * lost) / (2 * totals))}
        if k:
            suffix = np.searchsorted(below.nodes, level.nodes & _U((1 << 8 * k) - 1))
            taken = np.bincount(place, below.n[suffix], len(contexts))
            parent = np.searchsorted(under[0], contexts & _U((1 << 8 * (k - 1)) - 1))
            rest, free = under[1][parent] - taken, under[2][parent] - kinds + 2 * under[3][parent]
            columns["rest"] = np.log(np.maximum(2 * rest, 1))
            columns["escape_rest"] = np.where(free > 0, np.log(np.maximum(free, 1)) - columns["rest"], 0.0)
        log_n = np.log(2 * level.n - 1)
        trie.nodes.append(HashTable(level.nodes, {"n": log_n, "p": log_n - columns["all"][place]}))
        del columns["all"]
        trie.contexts.append(HashTable(contexts, columns))
        below, under = level, (contexts, totals, kinds, lost)  # under: contexts, totals, kinds and lost counts
    return below, under


def log_probabilities(trie: Trie, keys: np.ndarray) -> np.ndarray:
    """Natural log probability of each key's last byte after the bytes before it."""
    out = np.zeros(len(keys))
    todo, child = np.arange(len(keys)), np.full(len(keys), -1, np.int32)
    for k in range(trie.order, -1, -1):
        key = keys[todo] & _U((1 << 8 * (k + 1)) - 1)
        node = trie.nodes[k].find(key)
        hit = node >= 0
        # Without exclusion below the longest known context, else with the symbols of the next longer one excluded.
        longer = trie.contexts[k + 1].columns if k < trie.order and len(trie.contexts[k + 1].columns["rest"]) else None
        got, above, own = node[hit], child[hit], trie.nodes[k].columns
        if len(got):
            plain = own["p"][got]
            out[todo[hit]] += np.where(above < 0, plain, own["n"][got] - longer["rest"][above]) if longer else plain
        todo, above, key = todo[~hit], child[~hit], key[~hit]
        child = trie.contexts[k].find(key >> _U(8))
        escapes = trie.contexts[k].columns["escape"]
        if len(escapes) and len(todo):
            alone = np.where(child >= 0, escapes[child], 0.0)
            out[todo] += np.where(above < 0, alone, longer["escape_rest"][above]) if longer else alone
    out[todo] += trie.log_unseen
    return out


def _in_parts(trie: Trie, keys: np.ndarray, part: int = 1 << 18) -> np.ndarray:
    return np.concatenate([log_probabilities(trie, keys[i : i + part]) for i in range(0, len(keys), part)] or [np.zeros(0)])


def _cached(cache: HashTable, keys: np.ndarray, part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Each key's log probability, 0 where the table doesn't hold it; and where that is."""
    out, held = np.zeros(len(keys)), np.zeros(len(keys), bool)
    for i in range(0, len(keys), part):
        at = cache.find(keys[i : i + part])
        held[i : i + part] = hit = at >= 0
        out[i : i + part][hit] = cache.columns["p"][at[hit]]
    return out, np.flatnonzero(~held)


def _by_text(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) in order, and how often each is there."""
    place = np.lexsort((key, text))
    text, key = text[place], key[place]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))[: len(key)])
    return text[first], key[first], np.diff(np.append(first, len(key)))


def _sizes(nodes: DataFrame) -> list[tuple[int, int]]:
    """(log2 of the count, rows) of nodes."""
    sizes = nodes.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("rows")).collect()
    return [(r["level"], r["rows"]) for r in sizes]


def _fitting(nodes: DataFrame, order: int, max_nodes: int) -> tuple[int, DataFrame, dict[int, tuple]]:
    """The longest order with at most ``max_nodes`` nodes, its nodes, and of longer ones nodes and sizes."""
    longer = {}
    for k in range(order, -1, -1):
        sizes = _sizes(nodes)
        if k == 0 or sum(rows for _, rows in sizes) <= max_nodes:
            return k, nodes, longer
        longer[k] = (nodes, sizes)
        nodes = materialize(nodes.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.sum("n").alias("n")), "level")
    raise ValueError("order must be 0 or more")


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    key, n = t.column(0).to_numpy().view(_U), t.column(1).to_numpy()
    place = np.argsort(key)
    return key[place], n[place].astype(float)


def _whole(nodes: DataFrame, k: int) -> list[Level]:
    """Orders 0 to k from all nodes of order k."""
    levels = [Level(*_arrays(nodes))]
    for j in range(k, 0, -1):
        levels.insert(0, shorter(levels[0], j))
    return levels


def frequent_nodes(nodes: DataFrame, cut: int) -> Level:
    """The nodes that have that count, and their contexts' true totals."""
    totals = nodes.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.max("n").alias("most")).where(F.col("most") >= cut).drop("most")
    return Level(*_arrays(nodes.where(F.col("n") >= cut)), *_arrays(totals))


def levels_of(stats: DataFrame, order: int, max_nodes: int) -> list[Level]:
    """The levels of a trie of at most ``max_nodes`` nodes each; score() uses no cut ones.

    The longest order whose nodes fit is taken whole, and the shorter ones follow from
    it. Of longer orders the most frequent nodes are kept, by a count that all kept
    ones have and that doesn't fall with the order, and their contexts' true totals.
    """
    k, nodes, longer = _fitting(stats.where("key is not null").select("key", "n"), order, max_nodes)
    levels, cut = _whole(nodes, k), 0
    for j in range(k + 1, order + 1):
        cut = max(cut, cut_at(longer[j][1], max_nodes))
        levels.append(frequent_nodes(longer[j][0], cut))
    return levels


def resolved(asked: DataFrame, nodes: DataFrame, order: int, most: int) -> DataFrame:
    """key, log_p: each distinct asked key's natural log probability, from all nodes.

    Orders of ``most`` nodes at most are broadcast. A key's longer contexts all end in the same
    bytes, so nodes and asked keys are dealt by these, and each task builds the longer
    orders of its part.
    """
    spark = nodes.sparkSession
    k, fit, longer = _fitting(nodes, order, most)
    levels = _whole(fit, k)
    trie = Trie(order, [], [], -float(np.log(max(256 - len(levels[0].nodes), 1))))
    below, under = grow(trie, levels)
    base = spark.sparkContext.broadcast((trie, below, under))
    del levels, trie, below, under
    rows = asked.withColumn("n", F.lit(None).cast("long"))
    if longer:
        rows = rows.unionByName(nodes)
    ends = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * min(k + 1, order)) - 1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // _PART + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().view(_U), b.column(1).fill_null(0).to_numpy()) for b in batches]
        if not got:
            return
        key, n = (np.concatenate(x) for x in zip(*got, strict=True))
        keys = key[n == 0]
        if not len(keys):
            return
        whole, below, under = base.value
        trie = Trie(order, list(whole.nodes), list(whole.contexts), whole.log_unseen)
        if k < order:
            key, n = key[n > 0], n[n > 0]
            place = np.argsort(key)
            levels = [Level(key[place], n[place].astype(float))]
            for j in range(order, k + 1, -1):
                levels.insert(0, shorter(levels[0], j))
            grow(trie, levels, below, under)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(_in_parts(trie, keys))], ["key", "log_p"])

    bound_batches(spark, rows=100_000, mb=2)
    return materialize(rows.repartition(parts, ends).mapInArrow(run, "key long, log_p double"), "resolved")


def cut_at(sizes: list[tuple[int, int]], most: int) -> int:
    """The least power of two such that at most so many rows have that count or more;
    sizes: (log2 of the count, rows)."""
    kept, cut = 0, 0
    for level, rows in sorted(sizes, reverse=True):
        kept += rows
        if kept > most:
            return 1 << (level + 1)
        cut = 1 << level
    return cut


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_nodes: int = MAX_NODES, short: int = SHORT, frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the lower-cased words joined by one
    space and an end; ``base_score`` that of a smoothed unigram model of the words and
    the end. Both learn from the rows where ``train`` holds. Null and empty texts
    have the end only; without training rows all symbols are equally likely;
    repeated rows repeat; an empty table gives no rows; other columns are not read.
    Word counts are exact and joined by Spark. So is the trie, of which nothing is cut:
    probabilities of the ``max_nodes`` most frequent nodes at most are broadcast, and all
    other keys of the texts are resolved by resolved() and joined. ``max_nodes`` and
    ``short`` bound memory and don't change results.
    """
    spark = docs.sparkSession
    stats = statistics(docs, train, text_col, order)
    level = F.floor(F.log2("n")).cast("int").alias("level")
    sizes = stats.where("key is null").groupBy(level).agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.count_if(F.length("word") <= LONGEST).alias("short")).collect()
    n_all, n_kinds = (sum(r[c] for r in sizes) for c in ("n", "rows"))
    nodes = stats.where("key is not null").select("key", "n")
    top = frequent_nodes(nodes, cut_at(_sizes(nodes), max_nodes))
    totals = top.totals[np.searchsorted(top.contexts, top.nodes >> _U(8))]
    cache = spark.sparkContext.broadcast(HashTable(top.nodes, {"p": np.log(2 * top.n - 1) - np.log(2 * totals)}))
    del top, totals
    words = stats.where(F.col("key").isNull()).select("word", "n")
    least = cut_at([(r["level"], r["short"]) for r in sizes], frequent)
    # The end of a text is always at hand, however many words are more frequent.
    top = words.where((F.col("n") >= least) & (F.length("word") <= LONGEST) | (F.col("word") == F.lit(b"\n"))).toArrow()
    common = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), np.log10(top.column("n").to_numpy() + 0.1).tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            tokens = token_lists(batch.column(1))
            keys, size = context_keys(tokens, order)
            ends = np.cumsum(size)
            log_p, other = _cached(cache.value, keys)
            sums = np.concatenate([[0.0], np.cumsum(log_p)])
            at, asked, times = _by_text(np.searchsorted(ends, other, "right"), keys[other])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(tokens)))]).astype(np.int32)
            others = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(asked.view(np.int64)), pa.array(times.astype(np.int32))], ["key", "times"]))
            n_tokens, n_known, part, rare_words, rare_n, rare_size = [], [], [], [], [], []
            for t in tokens:
                rare: Counter | None = None
                total, hits = known.get(b"\n", 0.0), int(b"\n" in known)
                logs = list(map(known.get, t))
                if None in logs:
                    rare = Counter(w for w, x in zip(t, logs, strict=True) if x is None)
                    logs = [x for x in logs if x is not None]
                n_tokens.append(len(t) + 1)
                n_known.append(len(logs) + hits)
                part.append(sum(logs) + total)
                rare_size.append(len(rare) if rare else 0)
                if rare:
                    rare_words += rare.keys()
                    rare_n += rare.values()
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(rare_size)]).astype(np.int32), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_n, pa.int32())], ["word", "times"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(part, pa.float64()), pa.array((sums[ends] - sums[ends - size]) / np.log(10)), lists, others], ["doc_id", "train", "n_tokens", "n_known", "part", "score", "rare", "others"])

    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(spark, rows=500, mb=2)
    first = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train")).mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens long, n_known long, part double, score double, rare array<struct<word:binary,times:int>>, others array<struct<key:long,times:int>>")
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()), "first")
    rare = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    counts = rare.join(words, "word", "left")
    asked = first.select("row", F.explode("others").alias("o")).select("row", "o.key", "o.times")
    found = resolved(asked.select("key").distinct(), nodes, order, short)
    of_words = counts.select("row", F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("more"), (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rest"), F.lit(0.0).alias("log_p"))
    of_keys = asked.join(found, "key").select("row", F.lit(0).alias("more"), F.lit(0.0).alias("rest"), (F.col("times") * F.col("log_p")).alias("log_p"))
    sums = of_words.unionByName(of_keys).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "rest", "log_p")))
    end_unknown = 0 if n_all else -1.0  # an untrained end has count 0
    base = F.col("part") + F.coalesce("rest", F.lit(0.0)) + F.lit(float(end_unknown)) - F.col("n_tokens") * F.lit(float(np.log10(n_all + 0.1 * (n_kinds + 1))))
    score = F.col("score") + F.coalesce("log_p", F.lit(0.0)) / F.lit(float(np.log(10)))
    return first.drop("rare", "others").join(sums, "row", "left").select("doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def order_scores(docs: DataFrame, train: Column, orders: tuple[int, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per order: order, n_docs, n_better, score, base_score, for choosing an order.

    An eighth of the training rows, by a hash of id and text, is scored by models of the
    others; n_better of these n_docs rows have a higher score than base_score, and both
    are summed. Rows outside ``train`` are never read, so they can't flatter a choice.
    Rows repeated as a whole are on one side; null ids and texts are hashed like others;
    without scored rows n_docs is 0 and the sums are null.
    """
    rows = docs.where(train).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learned = F.pmod(F.xxhash64(F.lit("order"), "doc_id", "text"), F.lit(8)) != 0
    found = []
    for order in orders:
        scored = score(rows, learned, order=order).where("not train")
        found.append(scored.agg(F.lit(order).alias("order"), F.count("*").alias("n_docs"), F.count_if(F.col("score") > F.col("base_score")).alias("n_better"), F.sum("score").alias("score"), F.sum("base_score").alias("base_score")))
    return reduce(DataFrame.unionByName, found)


def op8_ppm(spark, sf_dir: str) -> DataFrame:
    train = crc_mod(F.col("doc_id"), 10) != 0
    return score(table(spark, sf_dir, "documents"), train).withColumn("held_out", ~F.col("train")).drop("train")
