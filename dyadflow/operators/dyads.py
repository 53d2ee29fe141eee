"""The canonical two-sided match table and its long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the one order every sequential operator uses
MATCH_ORDER = ["held_on", "event_id", "scheduled_at", "match_id"]


def derive_results(score_a, score_b, status) -> tuple[Column, Column]:
    """Outcome of each side from the scores; null where nothing can be said."""
    a_won = F.when(score_a > score_b, "win").when(score_b > score_a, "loss")
    b_won = F.when(score_a > score_b, "loss").when(score_b > score_a, "win")
    both = F.when(status == "no_contest", "no_contest")
    return (
        F.when(status == "completed", a_won).otherwise(both),
        F.when(status == "completed", b_won).otherwise(both),
    )


def completed_matches(matches: DataFrame, competitors: DataFrame) -> DataFrame:
    """One row per completed match with the lower athlete id as side a.

    The pairing is one aggregation on the match id instead of a self-join; a match that does not
    have exactly two competitors is left out.
    """
    sides = (
        competitors.groupBy("match_id")
        .agg(
            F.min("athlete_id").alias("athlete_a_id"),
            F.max("athlete_id").alias("athlete_b_id"),
            F.count(F.lit(1)).alias("_n"),
            F.min_by("result", "athlete_id").alias("result_a"),
        )
        .where((F.col("_n") == 2) & (F.col("athlete_a_id") < F.col("athlete_b_id")))
        .drop("_n")
    )
    return (
        matches.where(F.col("status") == "completed")
        .join(sides, "match_id")
        .select(
            "match_id", "event_id", "held_on", "scheduled_at", "arm", "weight_class",
            "athlete_a_id", "athlete_b_id", "result_a",
        )
    )


def competitor_names(competitors: DataFrame, athletes: DataFrame) -> DataFrame:
    """Matches that have exactly two named competitors, names in alphabetical order."""
    return (
        competitors.join(athletes, "athlete_id")
        .groupBy("match_id")
        .agg(
            F.min("canonical_name").alias("name_1"),
            F.max("canonical_name").alias("name_2"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where(F.col("_n") == 2)
        .drop("_n")
    )


def sides(matches: DataFrame, *extra: str, on_a: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per match and athlete, ``won`` as 1.0 or 0.0.

    ``on_a`` are columns that one row per match is enough to carry: side b has null there.
    """
    a_won = F.when(F.col("result_a") == "win", 1.0).otherwise(0.0)
    side = lambda name, me, other, won: F.struct(
        F.lit(name).alias("side"),
        F.col(me).alias("athlete_id"),
        F.col(other).alias("opponent_id"),
        won.alias("won"),
        *[F.when(F.lit(name == "a"), F.col(c)).alias(c) for c in on_a],
    )
    return matches.select(
        *MATCH_ORDER,
        *extra,
        F.explode(
            F.array(
                side("a", "athlete_a_id", "athlete_b_id", a_won),
                side("b", "athlete_b_id", "athlete_a_id", 1.0 - a_won),
            )
        ).alias("s"),
    ).select(*MATCH_ORDER, *extra, "s.*")


def per_side(name: str, side: str) -> Column:
    """Value of ``name`` on one side, for regrouping the long form by match."""
    return F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{name}_{side}")
