"""Natural keys of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.operators.running import ordinal
from dyadflow.staging import stage


def resolve_natural_keys(
    submissions: DataFrame, existing: DataFrame, max_rows_per_task: int | None = None
) -> DataFrame:
    """Natural key of each submitted match.

    ``submissions`` is (base_key, scheduled_at, seq, ...), ``existing`` (natural_key, base_key,
    scheduled_at). A submission at a known time under its base key is a replay and keeps the stored
    key; every new time is a rematch and takes the next number in order of arrival.
    """
    moments = submissions.groupBy("base_key", "scheduled_at").agg(F.min("seq").alias("_seq"))
    stored = existing.groupBy("base_key", "scheduled_at").agg(F.min("natural_key").alias("_stored"))
    counts = existing.groupBy("base_key").agg(F.count(F.lit(1)).alias("_count"))
    # one row per meeting, measured and then read twice
    known = stage(moments.join(stored, ["base_key", "scheduled_at"], "left"), "meetings")
    fresh = ordinal(
        known.where("_stored IS NULL"), ["base_key"], ["_seq"], "_rank", max_rows_per_task
    ).join(counts, "base_key", "left")
    number = F.coalesce("_count", F.lit(0)) + F.col("_rank") + 1
    suffixed = F.concat_ws(":", "base_key", number.cast("string"))
    keyed = known.where("_stored IS NOT NULL").select(
        "base_key", "scheduled_at", F.col("_stored").alias("natural_key")
    ).unionByName(
        fresh.select(
            "base_key", "scheduled_at",
            F.when(number == 1, F.col("base_key")).otherwise(suffixed).alias("natural_key"),
        )
    )
    return submissions.join(keyed, ["base_key", "scheduled_at"])
