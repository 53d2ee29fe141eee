"""Validated result rows into the canonical tables, as one batch plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.functions import text
from dyadflow.operators.dyads import derive_results
from dyadflow.operators.keys import resolve_natural_keys
from dyadflow.staging import stage


@dataclass(frozen=True)
class CanonicalRows:
    """Rows to upsert: events by slug, athletes by name, matches and competitors by their keys."""

    events: DataFrame
    athletes: DataFrame
    matches: DataFrame
    competitors: DataFrame
    videos: DataFrame


def surrogate(*columns: str):
    """Stable id of a natural key."""
    return F.xxhash64(*columns)


def canonical_rows(accepted: DataFrame, existing_matches: DataFrame) -> CanonicalRows:
    """Split accepted result rows (with ``seq``, their order of arrival) into canonical rows.

    ``existing_matches`` is (natural_key, base_key, scheduled_at); a replayed file resolves to the
    same keys and therefore to the same ids.
    """
    based = accepted.withColumn(
        "base_key", text.base_natural_key("event_slug", "athlete_a", "athlete_b", "arm")
    )
    # five tables are cut from these rows
    keyed = stage(
        resolve_natural_keys(based, existing_matches).withColumn(
            "match_id", surrogate("natural_key")
        ),
        "keyed-results",
    )
    result_a, result_b = derive_results(F.col("score_a"), F.col("score_b"), F.col("status"))
    events = keyed.select(
        surrogate("event_slug").alias("event_id"), F.col("event_slug").alias("slug"), "promoter",
        F.col("event_name").alias("name"), F.col("event_date").alias("held_on"), "seq",
    )
    matches = keyed.select(
        "match_id", "natural_key", "base_key", surrogate("event_slug").alias("event_id"),
        F.col("event_date").alias("held_on"), "arm", "weight_class", "scheduled_at", "status", "seq",
    )
    one = lambda s, r: F.struct(
        F.col(f"athlete_{s}").alias("canonical_name"), F.col(f"score_{s}").alias("score"),
        r.alias("result"),
    )
    competitors = keyed.select(
        "match_id", "seq", F.explode(F.array(one("a", result_a), one("b", result_b))).alias("c")
    ).select("match_id", surrogate("c.canonical_name").alias("athlete_id"), "c.*", "seq")
    athletes = competitors.select("athlete_id", "canonical_name").distinct()
    videos = keyed.where("video_id <> ''").select("match_id", "video_id").distinct()
    return CanonicalRows(events, athletes, matches, competitors, videos)
