"""Centroid clustering against a plain version in Python integers, at all magnitudes."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.llm import centroids

COLS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, size, k, rounds):
    kept = [(i, [math.floor(256 * int(x)) if abs(x) > 2**60 else math.floor(256 * x) for x in v], v) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    cs = [list(r[1]) for r in first]
    if not cs:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            cs[n] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    said = [(i, *near(v)) for i, v, _ in kept]
    per = {}
    for _, d, n in said:
        per[n] = per.get(n, 0) + d
    top = (1 << 63) - 1
    return sorted(((i, n, min(d, top), min(per[n], top), min(sum(per.values()), top), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, d, n in said), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def vectors(scale, n=90, size=4, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(size)]) for i in range(n)]
    rows += [(7, list(rows[7][1])), (n, list(rows[3][1])), (n + 1, [0.0] * size), (None, [0.5 * scale] * size)]  # repeats, ties, a null id
    return rows + [(n + 2, [1.0]), (n + 3, None), (n + 4, []), (n + 5, [None] * size), (n + 6, [float("nan")] * size), (n + 7, [float("inf")] + [0.0] * (size - 1))]


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6, 3e9, 1e14, 1e30, 1e306])
def test_all_magnitudes(spark, scale):
    rows = vectors(scale)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("cluster", "distance", "id", "vec", "name", "n", "kind")})
    assert got(centroids.cluster(df.repartition(3), size=4, k=6, rounds=3, block=16)) == plain(rows, 4, 6, 3)


def test_few_or_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = vectors(1.0, 8)
    assert got(centroids.cluster(spark.createDataFrame(rows, SCHEMA), size=4)) == plain(rows, 4, 40, 5)
    assert centroids.cluster(spark.createDataFrame(rows[-6:], SCHEMA), size=4).collect() == []


def test_empty_centroids_stay(spark):
    rows = [(i, [1.0, 1.0]) for i in range(50)] + [(99, [5.0, 5.0])]  # equal vectors start several centroids
    assert got(centroids.cluster(spark.createDataFrame(rows, SCHEMA), size=2, k=10)) == plain(rows, 2, 10, 5)


def test_query(spark, sf_dir):
    from motionlake.llm import queries

    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.QUERIES["op12_centroids"](spark, sf_dir)) == plain(rows, 64, 40, 5)


def test_distances_switch_at_the_bound():
    rng = np.random.default_rng(0)
    for top in (1 << 10, 1 << 22, 1 << 27, 1 << 40):
        x, c = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (7, 64))
        d = centroids.squared_distances(x, c)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert d.tolist() == want
