"""Toxicity by a counterfactual-regularised classifier.

Features are the distinct words of a text and their beginnings of 4 to 8 letters.
Spark counts each feature's texts by label; those that tell the labels apart best
become the model's features, and a logistic model is fitted to them. For sentences
that name an identity term, the same sentence with each other term of its group is a
counterfactual, and the fit penalises the squared difference of the two scores, so
that a neutral mention of a group does not look toxic. Groups are found in the labelled
texts: a word that is mostly mentioned in clean ones but has features of the model, and
the word that stands most often between the same neighbours. A short list of English
identity terms is added.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, materialize, table

#: Fixed value: groups of identity terms that stand for one another; a parameter of fit().
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "locals"), ("deaf", "blind", "disabled"), ("old", "young"),
)
#: Bounds of what the model is fitted on; parameters of fit(), which documents them.
SAMPLE_ROWS, MIN_TEXTS, MIN_G2 = 30_000, 4, 24.0
#: Words among which groups are looked for, the neighbours that describe them, and how alike two must be.
SWAP_WORDS, NEIGHBOURS, ALIKE = 2_000, 200, 0.5
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_MEMO = 300_000


def word_features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in range(4, 9) if len(word) >= n)]


@dataclass
class ToxicityModel:
    """weights: feature -> weight; pairs: the counterfactual pairs that it was fitted to; groups: the terms swapped."""

    bias: float = -50.0
    weights: dict[str, float] = field(default_factory=dict)
    pairs: int = 0
    groups: tuple[tuple[str, ...], ...] = ()

    def scorer(self):
        memo: dict[str, tuple[str, ...]] = {}

        def found(word: str) -> tuple[str, ...]:
            hit = memo.get(word)
            if hit is None:
                if len(memo) > _MEMO:
                    memo.clear()
                hit = memo[word] = tuple(f for f in word_features(word) if f in self.weights)
            return hit

        def score(text: str | None) -> float:
            hits = set().union(*map(found, set(_WORD.findall((text or "").lower()))))
            z = self.bias + sum(self.weights[f] for f in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

        return score


def _counts(rows: DataFrame) -> DataFrame:
    """feature, pos, neg: texts of either label that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}:
                    tally.setdefault(f, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([x[1] for x in tally.values()], pa.int64()), pa.array([x[0] for x in tally.values()], pa.int64())], ["feature", "pos", "neg"])

    parts = rows.select("text", "label").mapInArrow(run, "feature string, pos long, neg long")
    return parts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _words(rows: DataFrame) -> DataFrame:
    """label, words of each text in order, in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([_WORD.findall(t.lower()) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["label", "words"])

    return rows.select("text", "label").mapInArrow(run, "label int, words array<string>")


def swap_groups(rows: DataFrame, features: Sequence[str], min_texts: int = MIN_TEXTS, words: int = SWAP_WORDS, neighbours: int = NEIGHBOURS, alike: float = ALIKE) -> tuple[tuple[str, str], ...]:
    """Pairs of words that stand between the same neighbours, one of which has features of the model.

    Of ``rows`` (text, label): words of at least ``min_texts`` texts, most of them clean, so
    that a mention of them is neutral; of more than ``words`` with features and as many
    without, the most frequent ones. A word's description is how often each of the
    ``neighbours`` most frequent words comes right before and right after it. Each word with
    features is paired with the word whose description is most alike (cosine, at least
    ``alike``) and whose features differ; a word is in one pair, closest pairs first.
    """
    known = set(features)
    told = materialize(_words(rows), "words")
    per = told.select("label", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("texts"), F.sum("label").alias("toxic"))
    has = F.lit(False)
    if known:
        mark = rows.sparkSession.createDataFrame([(f,) for f in sorted(known)], "feature string")
        starts = F.explode(F.array_union(F.array(F.concat(F.lit("="), F.col("word"))), F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.concat(F.lit("^"), F.left("word", n)))))
        hit = per.select("word", starts.alias("feature")).join(mark, "feature").select("word").distinct().withColumn("has", F.lit(True))
        per, has = per.join(hit, "word", "left"), F.coalesce("has", F.lit(False))
    ranked = materialize(per.select("word", "texts", "toxic", has.alias("has")), "vocabulary")
    common = [r["word"] for r in ranked.orderBy(F.desc("texts"), "word").limit(neighbours).collect()]
    neutral = ranked.where((F.col("texts") >= min_texts) & (2 * F.col("toxic") <= F.col("texts")))
    terms = [r["word"] for kind in (True, False) for r in neutral.where(F.col("has") == kind).orderBy(F.desc("texts"), "word").limit(words).collect()]
    if len(terms) < 2:
        return ()
    at, place = {w: i for i, w in enumerate(common)}, {w: i for i, w in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[int, int], int] = {}
            for text in batch.column(0).to_pylist():
                for left, right in zip(text, text[1:]):
                    if left in at and right in place:
                        key = (place[right], 2 * at[left])
                        tally[key] = tally.get(key, 0) + 1
                    if right in at and left in place:
                        key = (place[left], 2 * at[right] + 1)
                        tally[key] = tally.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.int32()), pa.array([k[1] for k in tally], pa.int32()), pa.array(list(tally.values()), pa.int64())], ["term", "by", "n"])

    beside = told.select("words").mapInArrow(run, "term int, by int, n long").groupBy("term", "by").agg(F.sum("n").alias("n")).toArrow()
    profile = np.zeros((len(terms), 2 * len(common)))
    profile[beside.column("term").to_numpy(), beside.column("by").to_numpy()] = np.sqrt(beside.column("n").to_numpy())
    profile /= np.maximum(np.sqrt((profile**2).sum(1, keepdims=True)), 1e-12)
    own = [frozenset(f for f in word_features(w) if f in known) for w in terms]
    having = [i for i, f in enumerate(own) if f]
    close = np.round(profile[having] @ profile.T, 9)
    found, used = [], set()
    for k, i in enumerate(having):
        other = np.array([f != own[i] for f in own])
        j = int(np.argmax(np.where(other, close[k], -1.0)))
        if other[j] and close[k, j] >= alike:
            found.append((-close[k, j], terms[i], terms[j]))
    out = []
    for _, a, b in sorted(found):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return tuple(out)


def _design(rows: DataFrame, features: Sequence[str], groups: Sequence[Sequence[str]]) -> DataFrame:
    """own, swapped, label, n: how many texts have the feature numbers ``own`` (swapped is null), and
    how many sentences with an identity term have ``own`` and the counterfactual ``swapped``
    (label is null): one counterfactual for each number of places by which terms move on in
    their groups, until all have been everything else. Pairs of equal features, whose
    scores can't differ, are left out. Equal rows are counted before anything is collected.
    """
    number = {f: i for i, f in enumerate(features)}
    place = {t: (g, i) for g in groups for i, t in enumerate(g)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}

        def ids(words) -> tuple[int, ...]:
            found: set[int] = set()
            for w in set(words):
                hit = memo.get(w)
                if hit is None:
                    if len(memo) > _MEMO:
                        memo.clear()
                    hit = memo[w] = tuple(number[f] for f in word_features(w) if f in number)
                found.update(hit)
            return tuple(sorted(found))

        for batch in batches:
            tally: Counter[tuple] = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every: list[str] = []
                for sentence in _SENTENCE.split(text.lower()):
                    words = _WORD.findall(sentence)
                    every += words
                    if place.keys().isdisjoint(words):
                        continue
                    own = ids(words)
                    for by in range(1, max(len(place[w][0]) for w in words if w in place)):
                        swapped = ids(place[w][0][(place[w][1] + by) % len(place[w][0])] if w in place else w for w in words)
                        if swapped != own:
                            tally[own, swapped, None] += 1
                tally[ids(every), None, label] += 1
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in tally], t) for i, t in enumerate(kinds)), pa.array(list(tally.values()), pa.int64())], ["own", "swapped", "label", "n"])

    counted = rows.select("text", "label").mapInArrow(run, "own array<int>, swapped array<int>, label int, n long")
    return counted.groupBy("own", "swapped", "label").agg(F.sum("n").alias("n")).orderBy("label", "own", "swapped")


def _csr(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and feature number of each entry of a column of lists, and the number of rows."""
    sizes = pc.list_value_length(lists).to_numpy()
    return np.repeat(np.arange(len(lists), dtype=np.int32), sizes), pc.list_flatten(lists).to_numpy(), len(lists)


def _minimise(texts: pa.Table, pairs: pa.Table, n: int, ridge: float, fair: float, turns: int = 400) -> tuple[float, np.ndarray]:
    """Adam on the mean log loss + ridge / 2 * squared weights + fair * mean squared
    difference of the pairs' scores (probabilities), each text and pair as often as it
    occurs; the last turns take ever smaller steps."""
    x, before, after = _csr(texts.column("own")), _csr(pairs.column("own")), _csr(pairs.column("swapped"))
    times, y, often = texts.column("n").to_numpy(), texts.column("label").to_numpy(), pairs.column("n").to_numpy()
    share, often = times / times.sum(), often / max(often.sum(), 1)
    w = np.zeros(n + 1)
    toxic = (times * y).sum()
    w[n] = np.log((toxic + 0.5) / (times.sum() - toxic + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    logistic = lambda row, col, k: 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], k) + w[n], -50, 50)))
    for t in range(1, turns + 1):
        d = (logistic(*x) - y) * share
        g = np.append(np.bincount(x[1], d[x[0]], n), d.sum())
        g[:n] += ridge * w[:n]
        if before[2]:
            a, b = logistic(*before), logistic(*after)
            gap = 2 * fair * (a - b) * often
            ga, gb = gap * a * (1 - a), gap * b * (1 - b)
            g[:n] += np.bincount(before[1], ga[before[0]], n) - np.bincount(after[1], gb[after[0]], n)
            g[n] += (ga - gb).sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 * min(1.0, 4 * (1 - t / (turns + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(w[n]), w[:n]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", groups: Sequence[Sequence[str]] | None = None, fair: float = 10.0, ridge: float = 1e-4, sample_rows: int = SAMPLE_ROWS, min_texts: int = MIN_TEXTS, min_g2: float = MIN_G2) -> ToxicityModel:
    """Fit on the labelled rows, or where these are over ``sample_rows``, on about so many,
    chosen by a hash of the id; the driver gets their feature numbers only. The model's
    features are all that ``min_texts`` of these rows have and whose log-likelihood
    ratio with the label is ``min_g2`` or more (24: about one in a million by chance).
    ``groups`` of terms that stand for one another are ``swap_groups`` and the English list
    if None is given; a warning tells that no sentence has a counterfactual. Scoring reads
    all words of all texts.

    Rows with null text count as empty, rows with null label are left out; an id that
    is labelled more than once counts as toxic if any label says so. Without rows of
    both labels the model gives every text the smoothed share of label 1, and
    without any labelled row a score of 0.
    """
    bound_batches(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(marks, F.col("_doc") == F.col("_id")).select("_id", "text", "label")
    n = marks.count()
    if n > sample_rows:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "_id"), 32) < int(sample_rows / n * 2**32))
    rows = materialize(rows, "labelled")
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos + neg:
        return ToxicityModel()
    bias = float(np.log((pos + 0.5) / (neg + 0.5)))
    if not pos or not neg:
        return ToxicityModel(bias)
    # Log-likelihood ratio of feature and label over their 2 x 2 table.
    cell = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    total, a, b = float(pos + neg), F.col("pos"), F.col("neg")
    have, lack = a + b, F.lit(total) - a - b
    g2 = 2 * (cell(a, have * pos / total) + cell(b, have * neg / total) + cell(pos - a, lack * pos / total) + cell(neg - b, lack * neg / total))
    best = _counts(rows).where(have >= min_texts).withColumn("g2", g2).where(F.col("g2") >= min_g2)
    features = [r["feature"] for r in best.orderBy(F.desc("g2"), "feature").collect()]
    if groups is None:
        listed = {t for g in IDENTITY_GROUPS for t in g}
        groups = (*IDENTITY_GROUPS, *(g for g in swap_groups(rows, features, min_texts) if listed.isdisjoint(g)))
    design = _design(rows, features, groups).toArrow()
    whole = pc.is_null(design.column("swapped"))
    texts, pairs = design.filter(whole), design.filter(pc.invert(whole))
    n_pairs = int(pc.sum(pairs.column("n")).as_py() or 0)
    if fair and not n_pairs:
        warnings.warn("no sentence names a term whose swap changes a feature: the fit has no counterfactuals", stacklevel=2)
    bias, w = _minimise(texts, pairs, len(features), ridge, fair)
    return ToxicityModel(bias, dict(zip(features, w.tolist(), strict=True)), n_pairs, tuple(map(tuple, groups)))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, score (0 to 1) and predicted for every row; null texts count as empty.

    Repeated rows repeat; an empty table gives no rows; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            scores = np.array([scorer(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def fit_held_in(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model learned from rows whose crc32(doc_id) mod 5 is not 0."""
    return fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0), labels.where(crc_mod(F.col("doc_id"), 5) != 0))


def clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not call toxic, all columns, in one pass."""
    bound_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, all columns."""
    return clean(docs, fit_held_in(docs, labels))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit_held_in(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
