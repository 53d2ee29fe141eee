"""Evidence that was public before a match.

Counting per match does not need the (match, claim) pairs: claims and matches of an athlete are put
on one time line and the claims before each match are carried along. Work and output stay linear
in matches plus claims even when one athlete owns a third of both. The explicit listing exists for
the matches somebody wants to inspect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.functions import vocab
from dyadflow.operators.running import running_before

UNKNOWN_TIME = "unknown publication time"
TOO_LATE = "published at or after the match"


def annotated_claims(
    claims: DataFrame, annotations: DataFrame, model: str, prompt_version: str
) -> DataFrame:
    """Claims with the annotation one model and prompt gave them."""
    chosen = annotations.where(
        (F.col("model") == model) & (F.col("prompt_version") == prompt_version)
    ).drop("model", "prompt_version")
    return claims.join(chosen, "claim_id")


def missing_annotations(
    claims: DataFrame, annotations: DataFrame, model: str, prompt_version: str
) -> DataFrame:
    """Claims that one model and prompt have not annotated yet."""
    done = annotations.where(
        (F.col("model") == model) & (F.col("prompt_version") == prompt_version)
    ).select("claim_id")
    return claims.join(done, "claim_id", "left_anti")


def _facts(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Claims of one key and publication time, summed."""
    injury = F.max(F.when(F.col("claim_type") == "injury", F.col("published_at")))
    return claims.groupBy(*keys, "published_at").agg(
        F.count(F.lit(1)).alias("_claims"),
        F.count_if(F.col("claim_type").isin(*vocab.TECHNIQUE_CLAIM_TYPES)).alias("_technique"),
        injury.alias("_injury_at"),
    )


def _as_of(matches: DataFrame, facts: DataFrame, keys: list[str], max_rows) -> DataFrame:
    """Per match and key: what had been published strictly before the match."""
    known = facts.where("published_at IS NOT NULL").select(
        *keys, F.col("published_at").alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast("long").alias("match_id"), "_claims", "_technique", "_injury_at",
    )
    asked = matches.select(
        *keys, F.col("scheduled_at").alias("_t"), F.lit(0).alias("_kind"), "match_id",
        F.lit(0).cast("long").alias("_claims"), F.lit(0).cast("long").alias("_technique"),
        F.lit(None).cast("timestamp").alias("_injury_at"),
    )
    line = running_before(
        known.unionByName(asked), keys, ["_t", "_kind", "match_id"],
        sums={"eligible": "_claims", "technique": "_technique"},
        maxes={"injury_at": "_injury_at"},
        max_rows_per_task=max_rows,
    )
    totals = facts.groupBy(*keys).agg(
        F.sum(F.when(F.col("published_at").isNull(), F.col("_claims")).otherwise(0)).alias("unknown"),
        F.sum("_claims").alias("total"),
    )
    return line.where("_kind = 0").join(totals, keys, "left").select(
        *keys, "match_id", "eligible", "technique", "injury_at",
        F.coalesce("unknown", F.lit(0)).alias("unknown"),
        F.coalesce("total", F.lit(0)).alias("total"),
    )


def encode(
    matches: DataFrame,
    claims: DataFrame,
    subjects: DataFrame,
    max_rows_per_task: int | None = None,
) -> DataFrame:
    """Evidence columns of every match.

    ``claims`` is (claim_id, published_at, claim_type) already joined to one annotation;
    ``subjects`` links claims to athletes. A claim about both sides counts once: the sides are
    added and claims naming both are taken off again, for every two subjects of a claim. Subjects are
    competitors of the matches a claim is linked to, so a claim names a few athletes.
    """
    named = claims.select("claim_id", "published_at", "claim_type").join(
        subjects.select("claim_id", "athlete_id").distinct(), "claim_id"
    )
    other = named.select("claim_id", F.col("athlete_id").alias("athlete_b_id"))
    both = (
        named.withColumnRenamed("athlete_id", "athlete_a_id")
        .join(other, "claim_id")
        .where("athlete_a_id < athlete_b_id")
    )
    asked = matches.select(
        "match_id", "scheduled_at",
        F.explode(F.array("athlete_a_id", "athlete_b_id")).alias("athlete_id"),
    )
    per_athlete = _as_of(asked, _facts(named, ["athlete_id"]), ["athlete_id"], max_rows_per_task)
    pair = ["athlete_a_id", "athlete_b_id"]
    per_pair = _as_of(matches, _facts(both, pair), pair, max_rows_per_task)
    signed = per_athlete.select(
        "match_id", *_signed(1), "technique", "injury_at"
    ).unionByName(
        per_pair.select(
            "match_id", *_signed(-1), F.lit(0).cast("long").alias("technique"),
            F.lit(None).cast("timestamp").alias("injury_at"),
        )
    )
    summed = signed.groupBy("match_id").agg(
        *[F.sum(c).alias(c) for c in ("eligible", "unknown", "total", "technique")],
        F.max("injury_at").alias("injury_at"),
    )
    age = F.floor(
        (F.unix_micros("scheduled_at") - F.unix_micros("injury_at")) / F.lit(86_400_000_000)
    )
    return matches.select("match_id", "scheduled_at").join(summed, "match_id").select(
        "match_id",
        F.col("eligible").alias("evidence_count"),
        F.coalesce(age <= vocab.RECENT_INJURY_DAYS, F.lit(False)).alias("recent_injury_flag"),
        (F.col("technique") > 0).alias("technique_advantage_flag"),
        F.col("unknown").alias("unknown_time_count"),
        (F.col("total") - F.col("unknown") - F.col("eligible")).alias("too_late_count"),
    )


def _signed(sign: int) -> list[Column]:
    return [(F.col(c) * sign).alias(c) for c in ("eligible", "unknown", "total")]


def describe_claims(inspected: DataFrame, claims: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every claim about either athlete of the inspected matches, eligible or with the reason
    why not. For matches picked for explanation, not for the whole table."""
    asked = inspected.select(
        "match_id", "scheduled_at",
        F.explode(F.array("athlete_a_id", "athlete_b_id")).alias("athlete_id"),
    )
    reason = F.when(F.col("published_at").isNull(), UNKNOWN_TIME).when(
        F.col("published_at") >= F.col("scheduled_at"), TOO_LATE
    )
    return (
        asked.join(subjects.select("claim_id", "athlete_id"), "athlete_id")
        .select("match_id", "scheduled_at", "claim_id")
        .distinct()
        .join(claims, "claim_id")
        .withColumn("excluded_reason", reason)
        .withColumn("eligible", F.col("excluded_reason").isNull())
    )


def covered_matches(encoded: DataFrame) -> DataFrame:
    """Matches with at least one eligible claim."""
    return encoded.where("evidence_count > 0").select("match_id")
