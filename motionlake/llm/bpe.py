"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token is never merged
across, so a text may be cut there with certainty. A letter and a following space
are such a pair, so texts are first cut before white space (the few such pairs that
a token does have, as the last byte of a no-break space and a space, are kept apart
by the pre-tokenizer in any case). Each distinct fragment of a batch is encoded
once: further forced cuts inside its pieces, then merges by rank for all pieces of
one length together; documents' ids are put together from the fragments' ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import bound_batches, table

#: Fixed value: white space as Unicode and the pre-tokenizer define it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pre-tokenizer's pattern.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int32(1 << 30)
_CACHE = 300_000  # fragments that a worker remembers between batches
_LONG = 48  # bytes; longer pieces are merged one at a time


@dataclass
class Vocabulary:
    """Tables of a byte-level BPE tokenizer; its size is that of the vocabulary."""

    token_bytes: list[bytes]
    byte_id: np.ndarray  # [256] id of each single byte
    pair_keys: np.ndarray  # sorted left << 20 | right
    pair_rank: np.ndarray
    pair_id: np.ndarray
    forced: np.ndarray  # [256, 256] True where no token has the pair inside
    special: dict[str, int]


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _refuse_other_kinds(spec: dict) -> None:
    """Raise a ValueError for a file whose settings this encoder doesn't follow."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [f"normalizer {spec['normalizer']}"] if spec.get("normalizer") else []
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        wrong.append(f"pre_tokenizer {pre}")
    if model.get("type", "BPE") != "BPE":
        wrong.append(f"model {model['type']}")
    wrong += [f"model.{k} {model[k]}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    for token in spec["added_tokens"]:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) or regex.search(rf"[{WHITE}]", token["content"]):
            wrong.append(f"added token {token['content']!r}")
    if wrong:
        raise ValueError("only plain byte-level BPE files are read, not " + ", ".join(wrong))


def load_vocabulary(path: str) -> Vocabulary:
    """The tables of a tokenizers JSON file of plain byte-level BPE; others are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _refuse_other_kinds(spec)
    letters = _byte_letters()
    vocab = spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        token_bytes[i] = bytes(letters[c] for c in token)
    forced = np.ones((256, 256), bool)
    for token in token_bytes:
        b = np.frombuffer(token, np.uint8)
        forced[b[:-1], b[1:]] = False
    for token, i in special.items():
        token_bytes[i] = token.encode()
    byte_id = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
    made = np.array([vocab[a + b] for a, b in merges], np.int32)
    order = np.argsort(keys, kind="stable")
    return Vocabulary(token_bytes, byte_id, keys[order], np.arange(len(keys), dtype=np.int32)[order], made[order], forced, special)


class Encoder:
    """Encodes batches of texts; remembers the ids of fragments it has seen."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.fragment = regex.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.piece = regex.compile(PIECE)
        self.split = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # fragment -> place in start and size
        self.pool, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made id of pairs; the rank is _NONE where there is no merge."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.v.pair_keys, keys), len(self.v.pair_keys) - 1)
        return np.where(self.v.pair_keys[at] == keys, self.v.pair_rank[at], _NONE), self.v.pair_id[at]

    def merge_equal(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge pieces of one length (a row each): the lowest rank first, leftmost of
        equals, once a round. Yields the rows that are done with their ids."""
        rows, width = np.arange(len(ids)), ids.shape[1]
        if width > 1:
            rank, made = self.pairs(ids[:, :-1], ids[:, 1:])
        while width > 1 and len(rows):
            best = rank.argmin(1)
            go = rank[np.arange(len(rows)), best] != _NONE
            if not go.all():
                yield rows[~go], ids[~go]
                rows, ids, rank, made, best = rows[go], ids[go], rank[go], made[go], best[go]
            k = np.arange(len(rows))
            new = made[k, best]
            width -= 1
            col = np.arange(width)[None, :]
            ids = np.take_along_axis(ids, col + (col > best[:, None]), 1)
            ids[k, best] = new
            move = col[:, : width - 1] + (col[:, : width - 1] >= best[:, None])
            rank, made = np.take_along_axis(rank, move, 1), np.take_along_axis(made, move, 1)
            for at, ok in ((best - 1, best > 0), (best, best < width - 1)):
                x, y = k[ok], at[ok]
                rank[x, y], made[x, y] = self.pairs(ids[x, y], ids[x, y + 1])
        if len(rows):
            yield rows, ids

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: a heap of pairs over a linked list."""
        rank, made = self.pairs(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(int(r), i, ids[i], ids[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = m, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r, made_id = self.pairs(np.array([ids[x]]), np.array([ids[y]]))
                    if r[0] != _NONE:
                        heapq.heappush(heap, (int(r[0]), x, ids[x], ids[y], int(made_id[0])))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], np.int32)

    def merge(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of ``raw`` (non-empty) that begin at ``starts``; where each begins."""
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = self.v.forced[raw[:-1], raw[1:]]
        cut[starts] = cut[-1] = True
        at = np.flatnonzero(cut)
        at, size = at[:-1], np.diff(at)
        made, done = np.ones(len(at), np.int64), []
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            if n > _LONG:
                found = [(rows[i : i + 1], self.merge_long(self.v.byte_id[raw[at[r] : at[r] + n]])[None, :]) for i, r in enumerate(rows)]
            else:
                found = [(rows[r], ids) for r, ids in self.merge_equal(self.v.byte_id[raw[at[rows][:, None] + np.arange(n)]])]
            for r, ids in found:
                made[r] = ids.shape[1]
            done += found
        begin = np.cumsum(made) - made
        out = np.zeros(int(made.sum()), np.int32)
        for r, ids in done:
            out[begin[r][:, None] + np.arange(ids.shape[1])] = ids
        return out, begin[np.searchsorted(at, starts)]

    def learn(self, new: list[str]) -> None:
        """Encode fragments that aren't known yet."""
        if len(self.known) > _CACHE:
            self.forget()
        marked = [f for f in new if self.split and self.split.search(f)]
        plain = [f for f in new if not marked or not self.split.search(f)]
        pools, sizes = [self.pool], [self.size]
        if plain:
            found = list(map(self.piece.findall, plain))
            raw = [p.encode() for ps in found for p in ps]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            ids, begin = self.merge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size)
            count = np.fromiter(map(len, found), np.int64, len(found))
            edge = np.append(begin, len(ids))
            first = np.cumsum(count) - count
            pools.append(ids)
            sizes.append(edge[first + count] - edge[first])
        for f in marked:  # those with a special token's string
            parts = []
            for k, part in enumerate(self.split.split(f)):
                raw = [p.encode() for p in self.piece.findall(part)] if k % 2 == 0 else []
                size = np.array([*map(len, raw)], np.int64)
                parts.append(self.merge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size)[0] if raw else np.array([self.v.special[part]] if k % 2 else [], np.int32))
            pools.append(np.concatenate(parts))
            sizes.append(np.array([len(pools[-1])]))
        self.known.update(zip(plain + marked, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.pool, self.size = np.concatenate(pools), np.concatenate(sizes).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        found = [self.fragment.findall(t) for t in texts]
        new = list(set().union(*found).difference(self.known))
        if new:
            if len(self.known) > _CACHE:
                new = list(set().union(*found))
            self.learn(new)
        n = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
        ids = _gather(self.pool, self.start, self.size, codes)
        edge = np.concatenate([[0], np.cumsum(self.size[codes])])
        ends = np.cumsum(n)
        return ids, edge[ends] - edge[ends - n]


class Decoder:
    """Turns ids of batches of texts into texts."""

    def __init__(self, v: Vocabulary):
        self.pool, self.size = np.frombuffer(b"".join(v.token_bytes), np.uint8), np.fromiter(map(len, v.token_bytes), np.int64, len(v.token_bytes))
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of n[0], n[1], ... ids in a row; U+FFFD for bytes that aren't UTF-8."""
        raw = _gather(self.pool, self.start, self.size, ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[np.cumsum(n)]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Concatenate ``pool[start[c] : start[c] + size[c]]`` for all c of codes."""
    n = size[codes]
    at = np.repeat(start[codes] - (np.cumsum(n) - n), n)
    return pool[at + np.arange(len(at))]


def bpe_encode(docs: DataFrame, vocabulary: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Return doc_id, the columns ``keep`` and ids (array<int>) for each row; a null text
    has no ids.

    Special tokens' strings become their ids; none are added. Repeated rows repeat;
    an empty table gives no rows; other columns are not read. ``vocabulary`` is a
    tokenizers JSON file that the driver reads; executors get its tables (their
    size is that of the vocabulary) by broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    v = spark.sparkContext.broadcast(load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v.value)
        for batch in batches:
            ids, n = encoder.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["doc_id", *keep, "ids"])

    kinds = [("doc_id", docs.schema[id_col].dataType), *((c, docs.schema[c].dataType) for c in keep)]
    schema = StructType([StructField(c, kind) for c, kind in kinds] + [StructField("ids", ArrayType(IntegerType()))])
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str | Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Return doc_id, ids and text: the tokens' bytes as UTF-8, U+FFFD for what isn't."""
    spark = encoded.sparkSession
    bound_batches(spark)
    v = spark.sparkContext.broadcast(load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v.value)
        for batch in batches:
            lists = batch.column(1)
            texts = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of each row: encoded and decoded again in one pass.

    Rows are treated as by bpe_encode and bpe_decode.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    v = spark.sparkContext.broadcast(load_vocabulary(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(v.value), Decoder(v.value)
        for batch in batches:
            ids, n = encoder.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            digests_ = [hashlib.sha256(t.encode()).hexdigest() for t in decoder.decode(ids, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(digests_, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    return encoded(docs, vocabulary).select("doc_id", "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "decoded_sha256")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
