"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ``ORDER`` characters: counts of the longest runs, and
for shorter ones the number of characters that precede them, each discounted and
interpolated with the next shorter run. All languages' log probabilities are rows of
one table in a sorted hash array. A text gets the language of the lowest cross-entropy
per character; how far it leads is turned into a calibrated probability, and a text
that is unlike all languages' own texts is marked as rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, materialize, table
from .hashindex import HashTable

ORDER, BITS = 4, 16  # characters of a run; bits of a character's number: 65,534 letters, more than scripts in use have
#: The model is fitted to a sample of about so many characters of each language at most.
SAMPLE_CHARS = 4_000_000
_HASH = 1 << 40
_U = np.uint64
_PART = 1 << 18


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """For each code point its lower case if it is a letter or a mark, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters of all texts with one 0 between words, each text's number of them,
    and whether it has a letter."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    letters = np.bincount(doc[is_letter()[points]], minlength=len(texts)) > 0
    s = folded()[points]
    keep = s != 0
    keep[1:] |= (s[:-1] != 0) & (doc[1:] == doc[:-1])
    s, doc = s[keep], doc[keep]
    last = np.ones(len(s), bool)
    last[:-1] = doc[1:] != doc[:-1]
    keep = ~(last & (s == 0))
    s, doc = s[keep], doc[keep]
    return s, np.bincount(doc, minlength=len(texts)), letters


def runs(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of ORDER symbols (the newest in the lowest bits); how many each
    text has. A text is preceded by 0s and followed by one 0, which counts."""
    doc = np.repeat(np.arange(len(size)), size)
    padded = np.zeros(len(ids) + ORDER * len(size), _U)
    padded[np.arange(len(ids)) + ORDER * doc + ORDER - 1] = ids
    key = np.zeros(len(padded), _U)
    for back in range(ORDER):
        key[back:] |= padded[: len(padded) - back] << _U(BITS * back)
    begin = np.cumsum(size + ORDER) - size - ORDER
    own = np.ones(len(padded), bool)
    for i in range(ORDER - 1):
        own[begin + i] = False
    empty = size == 0
    own[begin[empty] + ORDER - 1] = False
    return key[own], np.where(empty, 0, size + 1)


@dataclass
class LanguageModel:
    """langs: names; alphabet: sorted folded code points, numbered from 1 (others share one number)."""

    langs: list[str]
    alphabet: np.ndarray
    keys: list[np.ndarray]  # of each order, the runs that any language has
    logp: list[np.ndarray]  # [runs, langs]
    contexts: list[np.ndarray]  # of each order, the runs but for their newest symbol
    log_gamma: list[np.ndarray]  # [contexts, langs]: what is left for shorter runs
    unseen: np.ndarray  # [langs]
    slope: tuple[float, float] = (0.0, 1.0)  # calibration of the lead
    most: np.ndarray | None = None  # [langs]: the highest cross-entropy that isn't rejected

    def numbers(self, points: np.ndarray) -> np.ndarray:
        return numbered(points, self.alphabet)

    def scorer(self):
        """A function from texts to cross-entropies [texts, langs], symbols and has-letter."""
        runs_at, contexts_at = ([HashTable(k, {"row": np.arange(len(k), dtype=np.int32)}) for k in keys] for keys in (self.keys, self.contexts))
        logp, gamma = ([a[t.columns["row"]] for a, t in zip(arrays, tables, strict=True)] for arrays, tables in ((self.logp, runs_at), (self.log_gamma, contexts_at)))

        def logs(keys: np.ndarray) -> np.ndarray:
            out = np.zeros((len(keys), len(self.langs)), np.float32)
            todo = np.arange(len(keys))
            for k in range(ORDER, 0, -1):
                key = keys[todo] & _U((1 << BITS * k) - 1)
                place = runs_at[k - 1].find(key)
                hit = place >= 0
                out[todo[hit]] += logp[k - 1][place[hit]]
                todo, key = todo[~hit], key[~hit]
                if not len(todo):
                    return out
                if k > 1:
                    place = contexts_at[k - 1].find(key >> _U(BITS))
                    known = place >= 0
                    out[todo[known]] += gamma[k - 1][place[known]]
            out[todo] += self.unseen
            return out

        def entropies(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            points, size, letters = symbols(texts)
            keys, n = runs(self.numbers(points), size)
            doc = np.repeat(np.arange(len(texts)), n)
            total = np.zeros((len(texts), len(self.langs)))
            for i in range(0, len(keys), _PART):
                part = logs(keys[i : i + _PART])
                own = doc[i : i + _PART]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[first]] += np.add.reduceat(part, first, axis=0, dtype=np.float64)
            return -total / np.maximum(n, 1)[:, None], n, letters

        return entropies

    def judged(self, entropies: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's place and by how far it leads (nats, tempered by length)."""
        best = entropies.argmin(1)
        if len(self.langs) < 2:
            return best, np.sqrt(n)
        two = np.partition(entropies, 1, axis=1)[:, :2]
        return best, (two[:, 1] - two[:, 0]) * np.sqrt(n)


def numbered(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """0 stays, letters of the alphabet count from 1, all others get the number after them."""
    at = np.searchsorted(alphabet, points)
    hit = alphabet[np.minimum(at, len(alphabet) - 1)] == points if len(alphabet) else np.zeros(len(points), bool)
    return np.where(points == 0, 0, np.where(hit, at + 1, len(alphabet) + 1)).astype(_U)


def _discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: np.ndarray) -> LanguageModel:
    """The model from each language's runs of ORDER symbols and their counts."""
    langs = sorted(counts)
    own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang in langs:
        key, n = counts[lang]
        order = np.argsort(key)
        levels = [(key[order], n[order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # how many symbols precede each shorter run
            shorter, before = np.unique(levels[0][0] & _U((1 << BITS * k) - 1), return_counts=True)
            levels.insert(0, (shorter, before.astype(np.float64)))
        own[lang] = levels
    keys = [np.unique(np.concatenate([np.zeros(0, _U), *(own[lang][k][0] for lang in langs)])) for k in range(ORDER)]
    contexts = [np.unique(k >> _U(BITS)) for k in keys]
    p = [np.zeros((len(k), len(langs))) for k in keys]
    gamma = [np.ones((len(c), len(langs))) for c in contexts]
    unseen = np.zeros(len(langs))
    for j, lang in enumerate(langs):
        for k in range(ORDER):
            mine, n = own[lang][k]
            d = _discount(n)
            context, place = np.unique(mine >> _U(BITS), return_inverse=True)
            total, kinds = np.bincount(place, n), np.bincount(place)
            at = np.searchsorted(contexts[k], context)
            gamma[k][at, j] = d * kinds / total
            all_total = np.ones(len(contexts[k]))
            all_total[at] = total
            there = np.searchsorted(contexts[k], keys[k] >> _U(BITS))
            if k == 0:
                below = np.full(len(keys[0]), 1.0 / (len(alphabet) + 2))
                unseen[j] = np.log(gamma[0][0, j] / (len(alphabet) + 2))
            else:
                below = p[k - 1][np.searchsorted(keys[k - 1], keys[k] & _U((1 << BITS * k) - 1)), j]
            got = np.zeros(len(keys[k]))
            got[np.searchsorted(keys[k], mine)] = n - d
            p[k][:, j] = got / all_total[there] + gamma[k][there, j] * below
    return LanguageModel(langs, alphabet, keys, [np.log(x).astype(np.float32) for x in p], contexts, [np.log(x).astype(np.float32) for x in gamma], unseen.astype(np.float32))


def _calibrate(model: LanguageModel, texts: list[str | None], langs: list[str]) -> None:
    """Fit the lead's slope and the rejection limits to texts that the counts don't hold."""
    entropies, n, letters = model.scorer()(texts) if texts else (np.zeros((0, len(model.langs))), np.zeros(0), np.zeros(0, bool))
    truth = np.array([model.langs.index(x) if x in model.langs else -1 for x in langs], np.int64)
    use = letters & (truth >= 0) if len(texts) else np.zeros(0, bool)
    model.most = np.full(len(model.langs), np.inf)
    if not use.any():
        return
    best, lead = model.judged(entropies[use], n[use])
    truth = truth[use]
    right = (best == truth).astype(float)
    a, b = 0.0, 1.0
    for _ in range(30):  # Newton on the ridge-penalised log loss
        z = 1 / (1 + np.exp(-np.clip(a + b * lead, -30, 30)))
        g = np.array([(z - right).sum() + 0.5 * a, ((z - right) * lead).sum() + 0.5 * (b - 1)])
        w = z * (1 - z)
        h = np.array([[w.sum() + 0.5, (w * lead).sum()], [(w * lead).sum(), (w * lead * lead).sum() + 0.5]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], max(b - step[1], 1e-3)
    model.slope = (float(a), float(b))
    for j in range(len(model.langs)):
        mine = entropies[use][truth == j, j]
        if len(mine) >= 20:
            model.most[j] = float(np.quantile(mine, 0.995)) * 1.25


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Fit on the rows with a text and a language.

    Of a language with more than ``sample_chars`` characters, rows are chosen by a hash
    of id and text so that about so many remain: the sample, and so what the driver
    gets, is bounded by the number of languages. Its row of the least hash among those
    with a letter is always learned, so no language with a letter is lost, however few
    or long its rows are. An eighth of the other rows is held back for calibration.
    Repeated rows count as often as they are there. Without any row the model knows no
    language. The table of runs has a column for each language: it suits tens of
    languages, not thousands.
    """
    bound_batches(docs.sparkSession, rows=1000, mb=4)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("lang"), id_col, text_col), F.lit(_HASH)).alias("h"))
    share = (F.lit(float(sample_chars)) / F.greatest(F.sum(F.length("text")), F.lit(1))).alias("share")
    shares = materialize(rows.groupBy(F.col("lang").alias("l")).agg(share, F.min(F.when(F.col("text").rlike(r"\p{L}"), F.col("h"))).alias("least")), "shares")
    always = F.coalesce(F.col("h") == F.col("least"), F.lit(False))
    chosen = rows.join(shares, F.col("lang") == F.col("l")).where((F.col("h") < F.col("share") * _HASH) | always)
    sample = materialize(chosen.select("lang", "text", ((F.col("h") % 8 == 0) & ~always).alias("held")), "sample")
    learned = sample.where("not held")

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, n = np.unique(symbols(batch.column(0).to_pylist())[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int32)), pa.array(n.astype(np.int64))], ["point", "n"])

    top = learned.select("text").mapInArrow(letters, "point int, n long").where("point > 0").groupBy("point").agg(F.sum("n").alias("n"))
    alphabet = np.sort(np.array([r["point"] for r in top.orderBy(F.desc("n"), "point").limit((1 << BITS) - 2).collect()], np.uint32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                points, size, _ = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang])
                keys, n = np.unique(runs(numbered(points, alphabet), size)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    found = learned.select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    lang, key, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "key", "n"))
    model = build({x: (key[lang == x].view(_U), n[lang == x]) for x in sorted(set(lang.tolist()))}, alphabet)
    held = sample.where("held").select("text", "lang").toArrow()
    _calibrate(model, held.column("text").to_pylist(), held.column("lang").to_pylist())
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, lang_pred, score, rejected and entropy for every row, from whole texts.

    ``lang_pred`` is ``und``, with score 0 and rejected, for null texts, texts without
    a letter, and all texts if the model knows no language. ``score`` is the
    calibrated probability that lang_pred is right; ``rejected`` says that the text is
    unlike the language's own texts. Repeated rows repeat; an empty table gives no
    rows; other columns are not read.
    """
    bound_batches(docs.sparkSession, rows=1000, mb=4)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        entropies_of = model.scorer() if model.langs else None
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            best, score, rejected, least = np.full(len(texts), len(model.langs)), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
            if entropies_of and texts:
                entropies, n, letters = entropies_of(texts)
                place, lead = model.judged(entropies, n)
                a, b = model.slope
                least = entropies[np.arange(len(texts)), place]
                best = np.where(letters, place, best)
                score = np.where(letters, np.round(1 / (1 + np.exp(-np.clip(a + b * lead, -30, 30))), 6), 0.0)
                rejected = ~letters | (least > model.most[place])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected), pa.array(np.round(least, 6))], ["doc_id", "lang_pred", "score", "rejected", "entropy"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, entropy double")


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(F.col(id_col), 4) == 2


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "entropy")
