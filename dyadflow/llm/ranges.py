"""Numbering and prefix sums over range-sorted rows, for groups of any size.

A window over a whole group puts a hot group into one task. Here the rows are range-sorted by
(group, order), so that a hot group spans many ranges; each range sums its own rows, and what the
earlier ranges of the group hold comes back as one row per (group, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.staging import stage


def range_sorted(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` written range-partitioned by ``order``; ``_part`` is the range, ``_tie`` orders equal rows.

    Written, because the borders come from a sample: whoever reads the ranges twice must see the
    same ones. ``_tie`` splits rows that agree in all of ``order`` over ranges as well.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(*order, "_tie").withColumn("_part", F.spark_partition_id())
    return stage(ranges, name)


def prefix_sum(
    ranged: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: Column, out: str
) -> DataFrame:
    """Append ``out``: the sum of ``value`` over the rows before this one in its group.

    ``group`` columns must not be null. Takes what ``range_sorted`` returns, sorted by the group
    first and ``order`` next.
    """
    own = ranged.withColumn("_value", value)
    inside = Window.partitionBy(*group, "_part").orderBy(*order, "_tie")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = own.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    totals = own.groupBy(*group, "_part").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        local.join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_value", "_local", "_offset")
    )
