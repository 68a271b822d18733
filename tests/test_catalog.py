"""Every registered motion query against its SQL, or for rows where SQL can't state it."""

import math

import duckdb
import pytest

from motionlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows, names):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[n]) for n in names) for r in rows)


@pytest.fixture(scope="module")
def larger(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def engine(larger):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, larger, engine, name):
    got = catalog.QUERIES[name](spark, larger)
    want = engine.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert _plain([r.asDict() for r in got.collect()], sorted(names)) == _plain(rows, sorted(names))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"model_out_of_fold", "training_run"}))
def test_query_runs(spark, sf_dir, name):
    one, two = (sorted(map(repr, catalog.QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert one and one == two


def test_partitioning_does_not_matter(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([_plain([r.asDict() for r in catalog.QUERIES[q](spark, sf_dir).collect()], sorted(catalog.QUERIES[q](spark, sf_dir).columns)) for q in ("trajectory_video", "interaction", "track_iou_hungarian")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_models_have_the_reference_sizes(spark, sf_dir, monkeypatch):
    from motionlake import registry
    from motionlake.operators import models

    made = []
    monkeypatch.setattr(models, "out_of_fold", lambda *a, **how: made.append(a[4]()))
    catalog.QUERIES["model_out_of_fold"](spark, sf_dir)
    assert (made[0].getNumTrees(), made[0].getMaxDepth()) == (200, 30)
    boosted = registry.build("model", "boosted_trees").getClassifier()
    assert (boosted.getMaxIter(), boosted.getMaxDepth()) == (200, 6)
    assert registry.build("model", "decision_tree").getMaxDepth() == 30
