"""Queries of the learning package over the embeddings, and the SQL of those that SQL can state."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..learning import boosting, kernel, training, trees
from ..operators import frames, learn
from ..operators.reuse import written
from ..sources import views

DEPTH = 3
_DIMS = [f"f{i}" for i in range(64)]


def _rows(spark, d) -> DataFrame:
    """id, label, features, and held_out: the first fifth of each class by id."""
    vectors = views.table(spark, d, "embeddings").where("label is not null")
    dealt = learn.holdout(vectors.select("vec_id", "label", "embedding"), "label", "vec_id", order=F.col("vec_id"))
    return dealt.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("features"), "held_out")


def exact_tree(spark, d) -> DataFrame:
    """The nodes of a tree of all vectors, split at every distinct value, to a depth of three."""
    nodes = trees.grow(_rows(spark, d).drop("held_out"), max_depth=DEPTH)
    return nodes.select("node", F.col("depth").cast("long").alias("depth"), "n", F.col("label").cast("long").alias("label"), F.col("feature").cast("long").alias("feature"), rounded("threshold").alias("threshold"), rounded("gain").alias("gain"))


def tree_holdout(spark, d) -> DataFrame:
    """Accuracy, precision, recall and F1 on held-out vectors of the tree of the others."""
    rows = written(_rows(spark, d), "vectors")
    nodes = trees.grow(rows.where("not held_out").drop("held_out"), max_depth=DEPTH)
    held = rows.where("held_out")
    said = trees.predicted(held, nodes).withColumnRenamed("label", "predicted").join(held.select("id", F.col("label").alias("truth")), "id")
    out = training.metrics(said.withColumn("model", F.lit("exact_tree")), ["model"])
    return out.select("model", "n", *(rounded(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


def _holdout(learned):
    """id, truth, predicted of the held-out vectors by a model of the others."""

    def query(spark, d) -> DataFrame:
        rows = written(_rows(spark, d), "vectors")
        held = rows.where("held_out")
        said = learned(rows.where("not held_out").drop("held_out"), held)
        return held.select("id", F.col("label").alias("truth")).join(said.select("id", F.col("label").alias("predicted")), "id", "left")

    return query


def _forest(train: DataFrame, held: DataFrame, n: int = 20) -> DataFrame:
    return trees.predicted(held, trees.grow(train, trees.bootstrap(train, n), per_node=8))


def _boosted(how: boosting.Settings):
    def learned(train: DataFrame, held: DataFrame) -> DataFrame:
        chance = F.col("probability")
        return boosting.probabilities(held, boosting.fit(train, how)).select("id", (F.array_position(chance, F.array_max(chance)) - 1).cast("int").alias("label"))

    return learned


def training_run(spark, d) -> DataFrame:
    """Per target and model the held-out metrics of whole pipelines: matrix, codes, scaling, model, names.

    The targets are the vectors' label and the distortion of the frame that each vector is. Three
    models are trained at the same time, as each has stretches that leave most cores idle.
    """
    seen = frames.distortion_label(frames.quality(views.frames(spark, d))).select(F.col("frame_no").alias("vec_id"), F.col("distortion_type").alias("distortion"))
    wide = views.table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label_name"), *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(_DIMS)))
    rows = written(wide.join(seen, "vec_id"), "vectors")
    models = [("lightgbm", {"n_estimators": 5}), ("svm_rbf", {"C": 10}), ("knn", {"n_neighbors": 5})]
    with ThreadPoolExecutor(len(models)) as pool:
        said = list(pool.map(lambda x: training.predictions(rows, _DIMS, x[0], x[1][0], "vec_id", order=F.col("vec_id"), share=0.2, **x[1][1]), product(("label_name", "distortion"), models)))
    return training.metrics(reduce(DataFrame.unionByName, said), ["target", "model", "held_out"])


QUERIES = {
    "exact_tree": exact_tree,
    "tree_holdout": tree_holdout,
    "forest_holdout": _holdout(_forest),
    "boosted_leaf_wise": _holdout(_boosted(boosting.leaf_wise(rounds=10))),
    "boosted_level_wise": _holdout(_boosted(boosting.level_wise(rounds=5))),
    "kernel_machine": _holdout(lambda train, held: kernel.predicted(held, kernel.fit(train))),
    "training_run": training_run,
}


def _tree_sql(where: str) -> str:
    """WITH parts of the tree of the vectors ``where`` holds: n<d> are the nodes of a depth, b<d> their splits."""
    parts = [f"""x AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings),
s0 AS MATERIALIZED (SELECT vec_id AS id, label, '' AS node FROM embeddings WHERE label IS NOT NULL AND {where})"""]  # fmt: skip
    for d in range(DEPTH + 1):
        parts.append(f"""n{d} AS MATERIALIZED (
  SELECT node, n, k, label FROM (
    SELECT node, label, sum(c) OVER (PARTITION BY node) AS n, count(*) OVER (PARTITION BY node) AS k, row_number() OVER (PARTITION BY node ORDER BY c DESC, label) AS r
    FROM (SELECT node, label, count(*) AS c FROM s{d} GROUP BY node, label)) WHERE r = 1)""")
        if d == DEPTH:
            break
        parts.append(f"""h{d} AS (SELECT node, f, v, label, count(*) AS c FROM s{d} JOIN x USING (id) WHERE node IN (SELECT node FROM n{d} WHERE k > 1 AND n >= 2) GROUP BY node, f, v, label),
g{d} AS (SELECT p.node, p.f, p.v, l.label, coalesce(h.c, 0) AS c
  FROM (SELECT DISTINCT node, f, v FROM h{d}) p JOIN (SELECT DISTINCT node, label FROM s{d}) l USING (node) LEFT JOIN h{d} h ON h.node = p.node AND h.f = p.f AND h.v = p.v AND h.label = l.label),
c{d} AS (SELECT node, f, v, sum(c) OVER (PARTITION BY node, f, label ORDER BY v)::DOUBLE AS a, sum(c) OVER (PARTITION BY node, f, label)::DOUBLE AS w FROM g{d}),
t{d} AS (SELECT node, f, v, a, w, w - a AS b, sum(a) OVER q AS na, sum(w) OVER q AS nw FROM c{d} WINDOW q AS (PARTITION BY node, f, v)),
e{d} AS (SELECT node, f, v,
    -sum(w / nw * ln(w / nw)) + max(na) / max(nw) * sum(CASE WHEN a > 0 THEN a / na * ln(a / na) ELSE 0 END)
    + (max(nw) - max(na)) / max(nw) * sum(CASE WHEN b > 0 THEN b / (nw - na) * ln(b / (nw - na)) ELSE 0 END) AS gain
  FROM t{d} WHERE na < nw GROUP BY node, f, v),
b{d} AS MATERIALIZED (SELECT node, f, v AS threshold, round(gain, 10) AS gain FROM e{d} QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 10) DESC, f, v) = 1),
s{d + 1} AS MATERIALIZED (SELECT s.id, s.label, s.node || CASE WHEN x.v <= b.threshold THEN '0' ELSE '1' END AS node FROM s{d} s JOIN b{d} b USING (node) JOIN x ON x.id = s.id AND x.f = b.f)""")  # fmt: skip
    return ",\n".join(parts)


_NODES = "\nUNION ALL ".join(
    f"SELECT n.node, {d} AS depth, n.n::BIGINT AS n, n.label::BIGINT AS label, {'b.f::BIGINT AS feature, round(b.threshold, 6) AS threshold, round(b.gain, 6) AS gain' if d < DEPTH else 'NULL, NULL, NULL'} FROM n{d} n" + (f" LEFT JOIN b{d} b USING (node)" if d < DEPTH else "")
    for d in range(DEPTH + 1)
)
_WALK = "\n".join(
    f"""r{d + 1} AS (SELECT r.id, r.truth, CASE WHEN b.node IS NULL OR length(r.node) < {d} THEN r.node WHEN x.v <= b.threshold THEN r.node || '0' ELSE r.node || '1' END AS node
  FROM r{d} r LEFT JOIN b{d} b USING (node) LEFT JOIN x ON x.id = r.id AND x.f = b.f),"""
    for d in range(DEPTH)
)
SQL = {
    "exact_tree": f"WITH {_tree_sql('true')}\nSELECT node, depth::BIGINT AS depth, n, label, feature, threshold, gain FROM ({_NODES})",
    "tree_holdout": f"""WITH dealt AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER w <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AND count(*) OVER (PARTITION BY label) > 1 AS held_out
  FROM embeddings WHERE label IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
{_tree_sql('vec_id IN (SELECT vec_id FROM dealt WHERE NOT held_out)')},
every AS ({_NODES}),
r0 AS (SELECT vec_id AS id, label AS truth, '' AS node FROM dealt WHERE held_out),
{_WALK}
said AS (SELECT truth, e.label AS predicted FROM r{DEPTH} r JOIN every e USING (node)),
per AS (SELECT truth AS c, count(*) AS support, sum((truth = predicted)::INT) AS hit FROM said GROUP BY truth),
full_ AS (SELECT c, support, hit, coalesce(called, 0) AS called FROM per LEFT JOIN (SELECT predicted AS c, count(*) AS called FROM said GROUP BY predicted) USING (c)),
pr AS (SELECT support, hit, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS p, hit / support AS r FROM full_)
SELECT 'exact_tree' AS model, sum(support)::BIGINT AS n, round(sum(hit) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
       round(sum(r * support) / sum(support), 6) AS recall, round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 6) AS f1
FROM pr""",
}
