"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each source has a token target. Document rates r minimise the relative entropy to
the uniform rate 1 under ``sum(r * size) = target`` and ``0 <= r <= cap``; the
solution is ``min(cap, exp(lambda * size / scale))`` with one dual variable per
source. Newton steps for all sources run at once over the exact size histogram.
The rates are rounded to copies by comparing their fractions with a hash of the
row's name; a threshold per source, found by three passes of ever finer buckets, and a few
last documents make the rounded words meet the target to a few words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
_STEPS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Return source, source_size, target for rows of (source, size).

    Sources in code point order, null last, take ``weights`` in turn and divide
    ``share`` times all sizes by them; a target stops at ``cap`` times its source's
    size and the excess is divided anew among the others until none is above.
    """
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    parts = materialize(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranked")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    before = parts.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    rank = (within + F.col("before") - 1) % len(weights)
    ranked = materialize(parts.join(before, "part").select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("double").alias("weight")), "weighted")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, most = 0.0, cap * F.col("source_size")
    while True:  # the level only rises; each turn stops one source more at least
        stopped = F.col("weight") * F.lit(level) >= most
        used, weight = ranked.agg(F.sum(F.when(stopped, most)), F.sum(F.when(~stopped, F.col("weight")))).first()
        risen = (share * total - (used or 0.0)) / weight if weight else level
        if not weight or risen <= level * (1 + 1e-12):
            break
        level = risen
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most).alias("target"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _exact(x: Column) -> Column:
    """A sum of ``x`` in whole units of 1e-8, so that the order of rows doesn't count."""
    return F.sum(x.cast("decimal(30,8)")).cast("double")


def dual_rates(hist: DataFrame, targets: DataFrame, cap: float = 2.0, steps: int = 100, tolerance: float = 1e-7) -> DataFrame:
    """Return source, scale and lam from rows (source, size, n) and targets.

    Newton steps on each source's convex dual, kept within a bracket that each
    gradient's sign narrows; ends when every source's words are within
    ``tolerance`` of its target, and raises an error if that takes over ``steps``.
    A target between 0 and ``cap`` times the source's size always has a solution:
    the bracket's ends take the rates of all sizes to 0 and to the cap.
    """
    scale = hist.groupBy("source").agg(F.max("size").cast("double").alias("scale"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    now = targets.join(scale.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), full.alias("full"))
    now = materialize(now.select("*", (-700 * F.col("scale")).alias("low"), (700 * F.col("scale")).alias("high"), F.lit(0.0).alias("lam"), F.lit(False).alias("done")), "dual")
    for _ in range(steps):
        x, size = F.col("size") / F.col("scale"), F.col("size").cast("double") * F.col("n")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        at = hist.alias("h").join(now.alias("d"), F.col("h.source").eqNullSafe(F.col("d.source")))
        sums = at.groupBy("d.source").agg(_exact(size * F.least(F.lit(cap), rate)).alias("got"), _exact(F.when(rate < cap, size * x * rate)).alias("slope"), *(F.first(c).alias(c) for c in ("target", "scale", "full", "low", "high", "lam")))
        gap = F.col("got") - F.col("target")
        done = F.col("full") | (F.abs(gap) <= tolerance * F.greatest("target", F.lit(1.0)))
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        middle = F.sinh((F.asinh(low) + F.asinh(high)) / 2)  # halves the bracket's order of magnitude
        nxt = F.when(done, F.col("lam")).when(inside, step).otherwise(middle)
        now = materialize(sums.select("source", "target", "scale", "full", low.alias("low"), high.alias("high"), F.round(nxt, 10).alias("lam"), done.alias("done")), "dual")
        if now.where("not done").isEmpty():
            return now.select("source", "scale", F.when(F.col("full"), 1e9).otherwise(F.col("lam")).alias("lam"))
    raise ArithmeticError(f"{now.where('not done').count()} sources did not meet their targets in {steps} Newton steps")


_ITS_CHANGE = "doc_id <=> i and size = s and source <=> o and twin <=> t"
_KEYS = ["doc_id", "source", "size"]


def _rate(cap: int) -> Column:
    """A row's rate, by its size and its source's dual variable."""
    return F.when(F.col("size") == 0, 1.0).otherwise(F.round(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(700.0)))), 9))


def _margin(cap: int) -> Column:
    """By how much a row's rate is above a whole number and a hash of its name; null where it can't have one copy more.

    A row's name is its id and, where several rows agree in id, source and size, its ``twin``.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "twin"), 12) / F.lit(float(1 << 52))
    return F.when((F.col("size") > 0) & (F.floor("rate") < cap), F.col("rate") - F.floor("rate") - u)


def _twins(docs: DataFrame, keys: list[Column], text_col: str, keep: list[Column]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``docs`` with doc_id, source, size and twin, as (those whose three keys no other row has, the others).

    A twin is the digest of the text and the row's place among those that agree in it too:
    rows of one id, or of none, are so rounded each on its own. Only they are moved; the
    second is None where there are none.
    """
    sized = materialize(docs.select(*keys), "keys")
    several = materialize(sized.groupBy(*_KEYS).count().where("count > 1").select(*(F.col(k).alias(f"_{k}") for k in _KEYS)), "several")
    rows = docs.select(*keep, *keys)
    if several.isEmpty():
        return rows.withColumn("twin", F.lit(None).cast("string")), None
    same = [rows[k].eqNullSafe(several[f"_{k}"]) for k in _KEYS]
    alone = rows.join(several, same, "left_anti").withColumn("twin", F.lit(None).cast("string"))
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    named = docs.select(*keep, *keys, digest.alias("_digest"))
    odd = named.join(several, [named[k].eqNullSafe(several[f"_{k}"]) for k in _KEYS], "left_semi")
    place = F.row_number().over(Window.partitionBy(*_KEYS, "_digest").orderBy(F.lit(0)))
    return alone, odd.withColumn("twin", F.concat_ws("/", "_digest", place.cast("string"))).drop("_digest")


def _rules(sized: DataFrame, weights: tuple[int, ...], share: float, cap: int, fixes: int) -> tuple[DataFrame, DataFrame]:
    """What tells each row's copies: per source (source, source_size, target, scale, lam, low), where low is
    the least margin that gets a copy more; and at most ``fixes`` changes a source (i, s, o, t, change)."""
    targets = materialize(source_targets(sized, weights, share, float(cap)), "targets")
    hist = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    dual = dual_rates(hist, targets, float(cap))
    plan = materialize(targets.alias("t").join(dual.alias("d"), F.col("t.source").eqNullSafe(F.col("d.source"))).select("t.*", "scale", "lam"), "plan")
    ready = sized.alias("a").join(plan.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source"))).select("doc_id", "a.source", "size", "twin", "target", _rate(cap).alias("rate")).withColumn("base", F.floor("rate")).withColumn("margin", _margin(cap))
    ready = materialize(ready, "rates")
    whole = ready.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("base"))).alias("need"))
    # Threshold search: (low, width) is the bucket of margins within which a source's need is met.
    found = materialize(whole.select("source", "need", F.lit(-1.0).alias("low"), F.lit(2.0).alias("width")), "threshold")
    for level in range(3):
        bucket = F.floor((F.col("margin") - F.col("low")) / F.col("width") * _STEPS)
        at = ready.alias("r").join(found.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source"))).select("f.source", "need", "low", "width", "size", bucket.alias("bucket")).where(f"bucket >= 0 and bucket < {_STEPS}")
        sums = at.groupBy("source", "bucket").agg(F.sum("size").alias("size"), *(F.first(c).alias(c) for c in ("need", "low", "width")))
        above = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        run = sums.withColumn("above", above)
        last = level == 2
        #: At the last level whole buckets are taken while that brings the sum nearer to the need.
        within = F.col("above") + (F.col("size") / 2 if last else F.lit(0)) < F.col("need")
        pick = run.where(within).groupBy("source").agg(F.min_by(F.struct("above", "bucket", "low", "width"), "bucket").alias("b"))
        low = F.col("b.low") + F.col("b.width") * F.col("b.bucket") / _STEPS
        nxt = pick.select(F.col("source").alias("s"), low.alias("l"), (F.col("b.width") / _STEPS).alias("w"), F.col("b.above").alias("a"))
        none = F.col("s0").isNull()
        nxt = nxt.withColumn("s0", F.lit(1))
        found = materialize(found.join(nxt, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.when(none, F.col("need")).otherwise(F.col("need") - F.col("a")).alias("need"), F.when(none, F.col("low") + F.col("width")).otherwise(F.col("l")).alias("low"), F.when(none, 0.0 if last else 1e-9).otherwise(F.col("w")).alias("width")), "threshold")
    rule = materialize(plan.alias("p").join(found.select("source", "low").alias("f"), F.col("p.source").eqNullSafe(F.col("f.source"))).select("p.*", "low"), "rule")
    copies = F.least(F.lit(cap), F.col("base") + F.when(F.col("margin") >= F.col("low"), 1).otherwise(0)).cast("int")
    rounded = materialize(ready.alias("r").join(found.select("source", "low").alias("f"), F.col("r.source").eqNullSafe(F.col("f.source"))).select("doc_id", "size", "r.source", "twin", "target", copies.alias("copies")), "rounded")
    # What is left of a source's need goes, turn by turn, to the document whose size is nearest to it.
    changes = rounded.select(F.col("doc_id").alias("i"), F.col("size").alias("s"), F.col("source").alias("o"), F.col("twin").alias("t"), F.lit(0).alias("change")).limit(0)
    for _ in range(fixes):
        now = rounded.join(changes, F.expr(_ITS_CHANGE), "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
        off = materialize(now.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off")), "off")
        can = F.when(F.col("off") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.abs(F.abs("off") - F.col("size")) < F.abs("off"))
        at = now.alias("r").join(off.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source"))).where(can)
        nearest = at.groupBy("r.source").agg(F.min(F.struct(F.abs(F.abs("off") - F.col("size")).alias("by"), F.xxhash64("doc_id", "twin").alias("order"), "doc_id", "twin", "size", F.signum("off").cast("int").alias("change"))).alias("m"))
        change = materialize(nearest.select(F.col("m.doc_id").alias("i"), F.col("m.size").alias("s"), F.col("source").alias("o"), F.col("m.twin").alias("t"), F.col("m.change").alias("change")), "change")
        if change.isEmpty():
            break
        changes = materialize(changes.union(change).groupBy("i", "s", "o", "t").agg(F.sum("change").cast("int").alias("change")), "changes")
    return rule, changes


def _with_copies(rows: DataFrame, rule: DataFrame, changes: DataFrame, cap: int) -> DataFrame:
    """``rows`` (doc_id, size, source, twin, ...) with source_size, target, rate and copies.

    Rows meet a row per source and a few changes a source, so they stay where they are
    as long as these tables are small enough for Spark to broadcast them.
    """
    own = rule.withColumnRenamed("source", "of")
    rated = rows.join(own, rows["source"].eqNullSafe(own["of"])).withColumn("rate", _rate(cap)).withColumn("margin", _margin(cap))
    copies = F.least(F.lit(cap), F.floor("rate") + F.when(F.col("margin") >= F.col("low"), 1).otherwise(0)).cast("int")
    return rated.join(changes, F.expr(_ITS_CHANGE), "left").withColumn("copies", copies + F.coalesce("change", F.lit(0))).drop("of", "scale", "lam", "low", "margin", "i", "s", "o", "t", "twin", "change")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, fixes: int = 8) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, rate, copies, taken.

    ``taken = copies * size`` and ``copies <= cap``. Null texts have size 0, and
    rows of size 0 get one copy (they take no words); null sources form one source
    that comes last; rows of one id, or of none, are rounded each on its own, by their
    texts and, where these are equal too, their places; an empty table gives no rows.
    Other columns are not read. At most ``fixes`` rows of a source are changed by a copy
    to come nearer to its target. Reruns agree: all choices depend on id, size, source and
    text and on exact sums.
    """
    keys = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")]
    alone, odd = _twins(docs, keys, text_col, [])
    sized = materialize(alone if odd is None else alone.unionByName(odd), "sizes")
    out = _with_copies(sized, *_rules(sized, weights, share, cap, fixes), cap)
    return out.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, fixes: int = 8) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, all columns.

    Its rows have the copies that ``mix`` gives them: those of one id, or of none, each its
    own. Rows without words stay once, null sources are one source, an empty table stays
    empty, and other columns, whatever their names, are passed on. Rows stay where they are
    but for those that agree in id, source and size with others.
    """
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    keys = [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")]
    alone, odd = _twins(docs, keys, text_col, [row])
    odd = None if odd is None else materialize(odd, "twins")
    names = [*_KEYS, "twin"]
    sized = materialize(alone.select(*names) if odd is None else alone.select(*names).unionByName(odd.select(*names)), "sizes")
    rules = _rules(sized, weights, share, cap, fixes)
    rows = _with_copies(alone, *rules, cap)
    if odd is not None:
        rows = rows.unionByName(_with_copies(odd, *rules, cap))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op7_entropy_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("rate", 9).alias("rate"))


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """The columns of op7_entropy_mix that SQL can state."""
    return op7_entropy_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


MIX_TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM d GROUP BY source),
-- The words per weight rise as sources stop at twice their size.
r AS (
  SELECT 0 AS turn, 0.0::DOUBLE AS level
  UNION ALL
  SELECT turn + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(CASE WHEN weight * r.level >= 2 * source_size THEN 2 * source_size END), 0)) / nullif(sum(CASE WHEN weight * r.level < 2 * source_size THEN weight END), 0) FROM s)
  FROM r WHERE turn < 50 AND level IS NOT NULL),
t AS (SELECT max(level) AS level FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(least(weight * t.level, 2 * source_size), 3) AS target
FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, t
"""
