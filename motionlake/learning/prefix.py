"""Running sums along a sorted key, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.reuse import written


def running_sums(rows: DataFrame, group: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` (one per group and order) with ``left_<c>``, the sum of c up to the row, and ``all_<c>``, that of its group.

    Rows are dealt out in ranges of (group, order), so that a group larger than a task is
    in several ranges; what a range adds is its own running sum and the totals of the
    group's ranges before, of which there are no more than ranges.
    """
    dealt = written(rows.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*group, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = totals.select(*group, "_range", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns), *(F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in columns))
    upto = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({f"_local_{c}": F.sum(c).over(upto) for c in columns})
    joined = local.join(offsets, [*group, "_range"])
    return joined.select(*rows.columns, *((F.col(f"_local_{c}") + F.col(f"_before_{c}")).alias(f"left_{c}") for c in columns), *(f"all_{c}" for c in columns))
