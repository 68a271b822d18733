"""Plain, slow versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def exact(rows):
    """rows: (doc_id, text). Returns doc_id, keep_id, group_size, kept, text_sha256."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, t), n in zip(rows, norm, strict=True):
        groups[n].append((-len(t or ""), i is None, i or 0, i))
    return [(i, min(groups[n])[3], len(groups[n]), min(groups[n])[3] == i, sha(n)) for (i, _), n in zip(rows, norm, strict=True)]


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def near(rows, percent=75):
    """Returns doc_id, n_shingles, component_id, kept."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return [(i, len(sets[i]), root(i), root(i) == i) for i, _ in rows]


def repeats(rows, window=35):
    """Returns doc_id, n_words, n_removed, kept_sha256."""
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def targets(sizes: dict, weights=(5, 2, 1), share=Fraction(3, 2), cap=2):
    """sizes: source -> words. Returns source -> target."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        whole = sum(weight[s] for s in free)
        over = [s for s in free if Fraction(left * weight[s], whole) > cap * sizes[s]]
        if not over:
            out |= {s: Fraction(left * weight[s], whole) for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
    return {s: float(x) for s, x in out.items()}


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + ["\n"]


def base_scores(rows, train):
    """doc_id, n_tokens, n_known, N, base_score of a unigram model of the training rows."""
    count = Counter(t for i, x in rows if train(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    out = []
    for i, x in rows:
        own = tokens(x)
        out.append((i, len(own), sum(count[t] > 0 for t in own), n, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)))
    return out


def ppm_scores(rows, train, order):
    """log10 probability of each text by PPM (method D, symbol exclusion) over bytes."""
    follows = defaultdict(Counter)

    def code(text):
        return b"\n" * order + b" ".join(t.encode() for t in tokens(text)[:-1]) + b"\n"

    for i, x in rows:
        if train(i):
            raw = code(x)
            for p in range(order, len(raw)):
                for k in range(order + 1):
                    follows[raw[p - k : p]][raw[p]] += 1
    out = []
    for _, x in rows:
        raw, total = code(x), 0.0
        for p in range(order, len(raw)):
            seen: set[int] = set()
            for k in range(order, -1, -1):
                here = {s: c for s, c in follows.get(raw[p - k : p], {}).items() if s not in seen}
                if not here:
                    continue
                n = sum(here.values())
                if raw[p] in here:
                    total += math.log10((2 * here[raw[p]] - 1) / (2 * n))
                    break
                total += math.log10(len(here) / (2 * n))
                seen |= here.keys()
            else:
                total += math.log10(1 / (256 - len(seen)))
        out.append(total)
    return out


def chats(rows):
    """rows: (conv_id, turn, role, text). Returns conv_id -> (n_turns, keep_id, kept)."""
    none_first = lambda x: (x is not None, x if x is not None else 0)
    text_first = lambda x: (x is not None, x or "")
    said = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda y: (none_first(y[1]), text_first(y[2]), text_first(y[3]))):
        said[c].append((r, x))
    out = {}
    for c, own in said.items():
        best = min((-len(other), d is None, d or 0, d) for d, other in said.items() if other[: len(own)] == own)
        out[c] = (len(own), best[3], best[3] == c)
    return out


def kneser_ney(texts_by_lang, order, symbol_count):
    """log probability functions (symbols, context) by language; texts are symbol lists ending in 0."""
    models = {}
    for lang, texts in texts_by_lang.items():
        grams = [None] * (order + 1)
        grams[order] = Counter(tuple(([0] * (order - 1) + t)[i : i + order]) for t in texts for i in range(len(t)))
        for k in range(order - 1, 0, -1):
            grams[k] = Counter(g[1:] if k == order - 1 else g[1:] for g in grams[k + 1])
        models[lang] = grams

    def prob(grams, gram):
        if not gram:
            return 1 / symbol_count
        k = len(gram)
        counts = list(grams[k].values())
        n1, n2 = counts.count(1), counts.count(2)
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        here = {g: c for g, c in grams[k].items() if g[:-1] == gram[:-1]}
        if not here:
            return prob(grams, gram[1:])
        total = sum(here.values())
        return max(here.get(gram, 0) - d, 0) / total + d * len(here) / total * prob(grams, gram[1:])

    return {lang: (lambda gram, g=grams: prob(g, gram)) for lang, grams in models.items()}


def gray_feature(payload: bytes) -> str:
    """Mean, deviation, entropy and mean change along rows of 64 of a payload's bytes."""
    n = len(payload)
    mean = sum(payload) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    change = sum(abs(payload[i] - payload[i + 1]) for i in range(n - 1) if i % 64 != 63) / (n // 64 * 63)
    return f"mean={mean:.6f};sd={sd:.6f};entropy={entropy:.6f};change={change:.6f}"


def toxic_features(rows, min_texts, min_g2):
    """rows: (text, label). The features whose log-likelihood ratio with the label is enough."""
    pos, neg = Counter(), Counter()
    for text, label in rows:
        words = set(re.findall(r"[^\W_]+", text.lower()))
        (pos if label else neg).update({f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in range(4, 9) if len(w) >= n})
    n1, n0 = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    out = {}
    for f in {*pos, *neg}:
        a, b = pos[f], neg[f]
        cells = [(a, (a + b) * n1), (b, (a + b) * n0), (n1 - a, (n1 + n0 - a - b) * n1), (n0 - b, (n1 + n0 - a - b) * n0)]
        g2 = 2 * sum(k * math.log(k * (n1 + n0) / e) for k, e in cells if k)
        if a + b >= min_texts and g2 >= min_g2:
            out[f] = g2
    return out


def fair_loss(bias, weights, texts, pairs, ridge, fair):
    """texts: (features, label); pairs: two feature sets each. The objective of the toxicity model."""
    score = lambda fs: 1 / (1 + math.exp(-bias - sum(weights[f] for f in fs)))
    loss = -sum(math.log(score(f) if y else 1 - score(f)) for f, y in texts) / len(texts)
    change = sum((score(a) - score(b)) ** 2 for a, b in pairs) / max(len(pairs), 1)
    return loss + ridge / 2 * sum(w * w for w in weights.values()) + fair * change
