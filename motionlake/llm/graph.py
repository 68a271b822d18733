"""Connected components of confirmed links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """Return node, comp for the nodes of ``links`` (a, b); comp is the smallest node.

    Each turn gives every node the least label among itself and its neighbours, then
    the label of that label, and moves the links to the labels. Links that have become
    loops or repeat are gone, so a star is done after one turn and each turn handles
    only the links that are still between different labels.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    named = None
    while named is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("low")), "near")
        jump = near.select(F.col("node").alias("low"), F.col("low").alias("to"))
        label = materialize(near.join(jump, "low").select("node", F.col("to").alias("comp")), "labels")
        if named is None:
            named = label
        else:
            later = label.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            named = materialize(named.join(later, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "named")
        one = edges.join(label.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").select("b", "x")
        two = one.join(label.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b").where("x <> y")
        edges = materialize(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return named


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components ``comp`` (node, comp) after more ``links`` (ca, cb) between components;
    a node that ``comp`` does not hold is a component of its own."""
    joined = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if comp is None:
        return joined
    to = joined.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    moved = comp.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    alone = joined.join(comp.select("node"), "node", "left_anti")
    return materialize(moved.unionByName(alone), "components")
