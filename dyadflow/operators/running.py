"""Aggregates over strictly earlier rows of a key, safe when one key holds most of the data.

A plain window sorts a whole key in one task. ``running_before`` measures the largest key first
and keeps the plain window while it fits. Beyond that the rows are range-partitioned by
(key, order), so a hot key spans many partitions; each partition keeps its own local window, and
what earlier partitions of the same key contribute is added as a small carry. A partition border
can split at most one key, so there are fewer carries than partitions; whether they are broadcast is
left to Spark, which checks their size.
Every row takes part in both paths and the values are identical.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.staging import stage

MAX_ROWS_PER_TASK = 4_000_000


@dataclass(frozen=True)
class LastK:
    """Keep ``fields`` of the last ``k`` earlier rows as an array of structs, oldest first."""

    fields: tuple[str, ...]
    k: int = 1


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest key: one map-side-combined count, one number to the driver."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, str | Column] | None = None,
    maxes: Mapping[str, str | Column] | None = None,
    last: Mapping[str, LastK] | None = None,
    max_rows_per_task: int | None = None,
    group_bound: int | None = None,
) -> DataFrame:
    """Append running aggregates over the rows strictly before each row of its key.

    ``order`` must be unique within a key. Missing history gives 0 for sums, null for maxima and
    an empty array for ``last``. ``group_bound`` is an upper limit on the rows of any key where
    the caller knows one; it saves the measurement.
    """
    sums, maxes, last = dict(sums or {}), dict(maxes or {}), dict(last or {})
    limit = MAX_ROWS_PER_TASK if max_rows_per_task is None else max_rows_per_task
    inputs = df.select(
        "*",
        *[_expr(c).alias(f"_in_{n}") for n, c in {**sums, **maxes}.items()],
        *[F.struct(*spec.fields).alias(f"_in_{n}") for n, spec in last.items()],
    )
    dropped = [f"_in_{n}" for n in (*sums, *maxes, *last)]
    largest = largest_group(df, keys) if group_bound is None or group_bound > limit else group_bound
    if largest <= limit:
        return _local(inputs, keys, order, sums, maxes, last).drop(*dropped)
    return _chunked(inputs, keys, order, sums, maxes, last, limit).drop(*dropped, "_chunk")


def _expr(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _local(df, keys, order, sums, maxes, last) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        *[F.coalesce(F.sum(f"_in_{n}").over(before), F.lit(0)).alias(n) for n in sums],
        *[F.max(f"_in_{n}").over(before).alias(n) for n in maxes],
        *[
            F.collect_list(f"_in_{n}").over(ordered.rowsBetween(-spec.k, -1)).alias(n)
            for n, spec in last.items()
        ],
    )


def _chunked(df, keys, order, sums, maxes, last, limit) -> DataFrame:
    parts = -(-df.count() // max(1, limit // 2))
    chunks = stage(
        df.repartitionByRange(parts, *keys, *order).withColumn("_chunk", F.spark_partition_id()),
        "chunks",
    )
    by = [*keys, "_chunk"]
    # keys that cross a partition border: at most one per border, so this stays tiny
    split_keys = (
        chunks.select(*by)
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
        if keys
        else None
    )
    crossing = chunks if split_keys is None else _match(chunks, split_keys, keys, "left_semi")
    totals = crossing.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_in_{n}").alias(f"_c_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_c_{n}") for n in maxes],
    )
    for name, spec in last.items():
        tail = (
            crossing.withColumn(
                "_r",
                F.row_number().over(
                    Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
                ),
            )
            .where(F.col("_r") <= spec.k)
            .groupBy(*by)
            .agg(F.sort_array(F.collect_list(F.struct(-F.col("_r"), f"_in_{name}"))).alias("_t"))
            .select(*by, F.col("_t").getField(f"_in_{name}").alias(f"_c_{name}"))
        )
        totals = _match(totals, tail, by, "inner")
    across = Window.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by,
        *[F.sum(f"_c_{n}").over(before).alias(f"_p_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(before).alias(f"_p_{n}") for n in maxes],
        *[
            F.flatten(F.collect_list(f"_c_{n}").over(across.rowsBetween(-spec.k, -1))).alias(
                f"_p_{n}"
            )
            for n, spec in last.items()
        ],
    )
    local = _local(chunks, by, order, sums, maxes, last)
    joined = _match(local, carry, by, "left")
    kept = [c for c in local.columns if c not in {*sums, *maxes, *last}]
    return joined.select(
        *kept,
        *[(F.col(n) + F.coalesce(F.col(f"_p_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(n), F.col(f"_p_{n}")).alias(n) for n in maxes],
        *[_tail(n, spec.k).alias(n) for n, spec in last.items()],
    )


def _tail(name: str, k: int) -> Column:
    merged = F.concat(F.coalesce(F.col(f"_p_{name}"), F.slice(F.col(name), 1, 0)), F.col(name))
    size = F.size(merged)
    return F.slice(merged, F.greatest(size - F.lit(k) + 1, F.lit(1)), F.lit(k))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe equi-join on ``keys`` keeping the left names."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    max_rows_per_task: int | None = None,
) -> DataFrame:
    """Dense 0-based position of each row within its key (or within the table)."""
    return running_before(
        df, keys, order, sums={name: F.lit(1)}, max_rows_per_task=max_rows_per_task
    )
