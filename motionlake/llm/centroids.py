"""Centroid clustering of embedding vectors in exact integers.

Vectors become integer components and are packed into blocks of a bounded size, one
block a row of a written table, so that a round reads plain arrays. Squared distances
of a block to all centroids are |x|^2 - 2 x.c + |c|^2, where x.c is one float64 matrix
product: exact as long as no partial sum can reach 2^53, which the magnitudes of block
and centroids bound beforehand. Beyond it the same sums are done in 64-bit integers,
and beyond these in Python integers. Each round's sums and counts are combined by
``treeAggregate``; only k rows ever come to the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Most vectors of a block; 64 components of 8 bytes make at most 2 MB.
BLOCK = 4096
EXACT, LONGEST = 1 << 53, (1 << 63) - 1
_PACKED = "kind string, n int, ids binary, none binary, data binary"
_PACKED_TYPE = pa.schema([("kind", pa.string()), ("n", pa.int32()), ("ids", pa.binary()), ("none", pa.binary()), ("data", pa.binary())])


def whole(vec: Column, size: int) -> Column:
    """Whether ``vec`` has exactly ``size`` components, none null or non-finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == size) & finite, F.lit(False))


def to_integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles: int64, or Python integers where these are too short.

    Scaling by a power of two is exact below the largest doubles, beyond them in integers.
    """
    with np.errstate(over="ignore"):
        scaled = np.floor(values * 256.0)
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([[int(v) if np.isfinite(v) else int(x) * 256 for v, x in zip(vs, xs, strict=True)] for vs, xs in zip(scaled.tolist(), values.tolist(), strict=True)], dtype=object)


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    """The shortest integers that hold the block: their kind and bytes, JSON for Python integers."""
    if x.dtype == object:
        return "json", json.dumps(x.tolist()).encode()
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


def _unpack(kind: str, n: int, data: bytes) -> np.ndarray:
    if kind == "json":
        return np.array(json.loads(data), dtype=object).reshape(n, -1)
    return np.frombuffer(data, kind).astype(np.int64).reshape(n, -1)


def packed(vectors: DataFrame, id_col: str, vec_col: str, size: int, block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` kept vectors: kind, n, ids, none (which ids are null), data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                ids, values = part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)
                kind, data = _pack(to_integers(values))
                none = np.asarray(ids.is_null()).astype(np.uint8).tobytes()
                row = [[kind], [part.num_rows], [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], [none], [data]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _PACKED_TYPE.types, strict=True)], _PACKED_TYPE.names)

    vec = F.col(vec_col).cast("array<double>")
    kept = vectors.where(whole(vec, size)).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return kept.mapInArrow(run, _PACKED)


def first_centroids(vectors: DataFrame, id_col: str, vec_col: str, size: int, k: int, salt: str) -> np.ndarray:
    """The k kept vectors of the smallest sha256 of ``salt`` and the id, as integers."""
    vec = F.col(vec_col).cast("array<double>")
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = vectors.where(whole(vec, size)).select(name.alias("name"), vec.alias("vec")).orderBy("name", "vec").limit(k).collect()
    return to_integers(np.array([r["vec"] for r in rows], float).reshape(len(rows), size))


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``, integers both."""
    most = (int(abs(x).max()) + int(abs(c).max())) if x.size and c.size else 0
    bound = x.shape[1] * most * most  # of |x|^2 + 2|x.c| + |c|^2 and of each partial sum
    if bound < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]
        return d.astype(np.int64)
    kind = np.int64 if bound < LONGEST else object
    a, b = x.astype(kind), c.astype(kind)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def assigned(x: np.ndarray, c: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the nearest centroid, of equally near ones the smallest number, and the distance."""
    parts = [squared_distances(x[i : i + rows], c) for i in range(0, len(x), rows)]
    place = np.concatenate([p.argmin(1) for p in parts])
    return place, np.concatenate([p.min(1) for p in parts])


def block_sums(x: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums and counts by cluster; 64-bit where they can't overflow."""
    counts = np.bincount(place, minlength=k).astype(np.int64)
    kind = np.int64 if len(x) * (int(abs(x).max()) if x.size else 0) < LONGEST else object
    sums = np.zeros((k, x.shape[1]), kind)
    np.add.at(sums, place, x.astype(kind))
    return sums, counts


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact sum; Python integers as soon as 64 bits might be too short."""
    if a.dtype != object and b.dtype != object and a.size and int(abs(a).max()) + int(abs(b).max()) < LONGEST:
        return a + b
    return a.astype(object) + b.astype(object)


def fit(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, list[int]]:
    """The centroids after ``rounds`` and, after one more assignment, each cluster's inertia."""
    context, k = blocks.sparkSession.sparkContext, len(centroids)
    rows = blocks.select("kind", "n", "data").rdd
    for _ in range(rounds):
        shared = context.broadcast(centroids)  # k rows

        def add(total, row, shared=shared):
            x = _unpack(row["kind"], row["n"], row["data"])
            sums, counts = block_sums(x, assigned(x, shared.value)[0], k)
            return plus(total[0], sums), total[1] + counts

        zero = (np.zeros(centroids.shape, np.int64), np.zeros(k, np.int64))
        sums, counts = rows.treeAggregate(zero, add, lambda a, b: (plus(a[0], b[0]), a[1] + b[1]))
        shared.unpersist()
        moved = counts > 0
        centroids = centroids.astype(sums.dtype) if sums.dtype == object else centroids.copy()
        if moved.any():
            centroids[moved] = (sums[moved] // counts[moved][:, None]).astype(centroids.dtype)
    shared = context.broadcast(centroids)

    def inertia(total, row):
        place, far = assigned(_unpack(row["kind"], row["n"], row["data"]), shared.value)
        per = np.zeros(k, object)
        np.add.at(per, place, far.astype(object))
        return total + per

    found = rows.treeAggregate(np.zeros(k, object), inertia, lambda a, b: a + b)
    shared.unpersist()
    return centroids, [int(v) for v in found]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, salt: str = "2:", block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Left out are vectors of another size than ``size`` and those with a null or non-finite
    component; a null id is kept and named as ''. Rows of one id are vectors of their own.
    With fewer than ``k`` kept vectors each starts a centroid; with none, or of an empty
    table, there are no rows. Equal vectors share a cluster; a centroid without vectors
    stays where it is. Distances and inertias are exact; beyond the largest long they are
    that long. Other columns are not read.
    """
    start = first_centroids(vectors, id_col, vec_col, size, k, salt)
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(start):
        return spark.createDataFrame([], schema)
    blocks = materialize(packed(vectors, id_col, vec_col, size, block), "blocks")
    centroids, per = fit(blocks, start, rounds)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    bounded = lambda v: min(int(v), LONGEST)
    shared, total, own = spark.sparkContext.broadcast(centroids), bounded(sum(per)), [bounded(v) for v in per]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                place, far = assigned(_unpack(r["kind"], r["n"], r["data"]), shared.value)
                ids = pa.array(np.frombuffer(r["ids"], "<i8"), pa.int64(), mask=np.frombuffer(r["none"], np.uint8).astype(bool))
                cols = [ids, pa.array(place, pa.int32()), pa.array([bounded(v) for v in far.tolist()], pa.int64()), pa.array(np.array(own)[place], pa.int64()), pa.array(np.full(len(place), total), pa.int64()), pa.array([names[p] for p in place], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, schema)


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds one after the other; a vector is its number and components, a centroid too."""
    far = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = ["""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, sha256('2:' || vec_id) AS name
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY name) - 1)::INT AS n, v AS c FROM v QUALIFY n < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, n, {far} AS d FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, n) = 1)")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT n, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT n, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY j) AS m FROM (
      SELECT n, j, sum(x) AS s, count(*) AS m FROM (SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY n, j) GROUP BY n) USING (n))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, n AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (n)"""  # fmt: skip


OP12_SQL = _sql()
