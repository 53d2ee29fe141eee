"""Prediction quality and paired comparison of two runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.functions import scoring, vocab
from dyadflow.session import ship_package


def metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size, accuracy with its interval, log-loss and Brier score from (p_a, a_won)."""
    summed = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(scoring.is_correct("p_a", "a_won")).alias("correct"),
        F.avg(scoring.log_loss("p_a", "a_won")).alias("log_loss"),
        F.avg(scoring.squared_error("p_a", "a_won")).alias("brier_score"),
    )
    low, high = scoring.wilson("correct", "n")
    known = lambda c: F.when(F.col("n") > 0, c)
    return summed.select(
        *by, "n",
        known(F.col("correct") / F.col("n")).alias("accuracy"),
        known(low).alias("accuracy_ci_lower"),
        known(high).alias("accuracy_ci_upper"),
        "log_loss", "brier_score",
    )


def paired(
    matches: DataFrame, run_a: DataFrame, run_b: DataFrame, restrict: DataFrame | None = None
) -> DataFrame:
    """Matches that both runs predicted, with both probabilities for side a."""
    side_a = lambda run, name: run.select(
        "match_id", F.col("athlete_id").alias("athlete_a_id"), F.col("p_win").alias(name)
    )
    pairs = (
        matches.select(
            "match_id", "athlete_a_id", (F.col("result_a") == "win").alias("a_won")
        )
        .join(side_a(run_a, "p_run_a"), ["match_id", "athlete_a_id"])
        .join(side_a(run_b, "p_run_b"), ["match_id", "athlete_a_id"])
    )
    if restrict is not None:
        pairs = pairs.join(restrict.select("match_id"), "match_id", "left_semi")
    return pairs.select("match_id", "a_won", "p_run_a", "p_run_b")


def discordance(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracies, discordant counts and the exact McNemar p-value."""
    a = scoring.is_correct("p_run_a", "a_won")
    b = scoring.is_correct("p_run_b", "a_won")
    counted = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a).alias("_right_a"),
        F.count_if(b).alias("_right_b"),
        F.count_if(a & ~b).alias("a_right_b_wrong"),
        F.count_if(b & ~a).alias("b_right_a_wrong"),
    )
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    return counted.select(
        *by, "n",
        share("_right_a").alias("accuracy_a"),
        share("_right_b").alias("accuracy_b"),
        "a_right_b_wrong", "b_right_a_wrong",
        scoring.mcnemar_exact("a_right_b_wrong", "b_right_a_wrong").alias("mcnemar_p_value"),
    )


# the resampling hash: modular squaring in 64-bit integers, the same in any SQL engine
HASH_PRIME = 2_147_483_647
HASH_ID, HASH_HIGH, HASH_DRAW, HASH_SEED = 48_271, 40_692, 69_621, 7_919
BLOCK_ROWS = 512  # rows weighed at a time


def poisson_thresholds(limit: int = 12) -> list[int]:
    """Hash values at which a Poisson(1) weight steps from i to i + 1."""
    cumulative, term, steps = 0.0, math.exp(-1.0), []
    for i in range(limit):
        cumulative += term
        term /= i + 1
        steps.append(int(cumulative * HASH_PRIME))
    return steps


def resample_weights(ids, draws, seed: int = 0):
    """Matrix (ids x draws): how often each row occurs in each resample.

    The whole 64-bit id takes part: its remainder and its quotient modulo the prime enter on their own.
    """
    import numpy as np

    high, low = np.divmod(np.asarray(ids, dtype=np.int64), HASH_PRIME)
    low, high = low[:, None], (high % HASH_PRIME)[:, None]
    draws = np.asarray(draws, dtype=np.int64)[None, :]
    x = (low * HASH_ID + high * HASH_HIGH + draws * HASH_DRAW + (seed * HASH_SEED + 12_345)) % HASH_PRIME
    x = (x * x + draws + 1) % HASH_PRIME
    x = (x * x + low + high) % HASH_PRIME
    return np.searchsorted(np.array(poisson_thresholds()), x, side="right")


def bootstrap_interval(
    pairs: DataFrame,
    resamples: int = vocab.BOOTSTRAP_RESAMPLES,
    alpha: float = vocab.BOOTSTRAP_ALPHA,
    seed: int = 0,
) -> DataFrame:
    """Percentile interval of the mean log-loss difference (run a minus run b).

    Drawing n rows out of n by index would need a lookup of every draw in the whole pair set.
    Here each row decides on its own how often it is in each resample (independent Poisson(1)
    weights, the large-n limit of drawing with replacement), so the rows are read once, weighed in
    blocks, and only one partial sum per resample leaves a task. Rows without an id or a difference
    take no part.
    """
    diffs = pairs.select(
        F.col("match_id").cast("long").alias("_id"),
        (
            scoring.log_loss("p_run_a", "a_won") - scoring.log_loss("p_run_b", "a_won")
        ).alias("_d"),
    )
    def partial_sums(batches):
        import numpy as np
        import pyarrow as pa

        draws = np.arange(resamples)
        counts, totals = np.zeros(resamples, dtype=np.int64), np.zeros(resamples)
        for batch in batches:
            ids, values = (column.to_numpy() for column in batch.columns)
            for at in range(0, len(ids), BLOCK_ROWS):
                weights = resample_weights(ids[at : at + BLOCK_ROWS], draws, seed)
                counts += weights.sum(axis=0)
                totals += values[at : at + BLOCK_ROWS] @ weights
        if counts.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(draws), pa.array(counts), pa.array(totals)], names=["_b", "_n", "_s"]
            )

    ship_package(pairs.sparkSession)
    means = (
        diffs.where("_id IS NOT NULL AND _d IS NOT NULL")
        .mapInArrow(partial_sums, "_b bigint, _n bigint, _s double")
        .groupBy("_b")
        .agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        .where("_n > 0")
        .select((F.col("_s") / F.col("_n")).alias("_mean"))
    )
    low = int(alpha / 2 * resamples)
    high = min(resamples - 1, int((1 - alpha / 2) * resamples))
    # at most `resamples` numbers meet here
    ranked = means.agg(F.array_sort(F.collect_list("_mean")).alias("_m"))
    at = lambda i: F.coalesce(
        F.try_element_at("_m", F.least(F.lit(i + 1), F.greatest(F.size("_m"), F.lit(1)))), F.lit(0.0)
    )
    bounds = ranked.select(at(low).alias("ci_lower"), at(high).alias("ci_upper"))
    return bounds.withColumn(
        "distinguishable", ~((F.col("ci_lower") <= 0.0) & (F.col("ci_upper") >= 0.0))
    )


def compare_runs(
    matches: DataFrame,
    run_a: DataFrame,
    run_b: DataFrame,
    protocol_a: int,
    protocol_b: int,
    restrict: DataFrame | None = None,
) -> DataFrame:
    """Full comparison of two runs of one protocol as a single row."""
    if protocol_a != protocol_b:
        raise ValueError(f"protocols {protocol_a} and {protocol_b} differ")
    pairs = paired(matches, run_a, run_b, restrict)
    # two one-row results side by side
    left = discordance(pairs).withColumn("_one", F.lit(1))
    right = bootstrap_interval(pairs).withColumn("_one", F.lit(1))
    return left.join(right, "_one").drop("_one")


def calibration(predictions: DataFrame, buckets: int = 5) -> DataFrame:
    """Hit rate of the favoured side by confidence bucket over [0.5, 1]."""
    confidence = F.greatest(F.col("p_a"), 1.0 - F.col("p_a"))
    bucket = F.least(
        F.floor((confidence - 0.5) * F.lit(2 * buckets)).cast("long"), F.lit(buckets - 1).cast("long")
    )
    return (
        predictions.withColumn("bucket", bucket)
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(scoring.is_correct("p_a", "a_won")).alias("hits"),
            F.avg(confidence).alias("mean_confidence"),
        )
        .withColumn("hit_rate", F.col("hits") / F.col("n"))
    )


def consensus(forecasts: DataFrame) -> DataFrame:
    """How often agreement among forecasters was right, by how many of them agreed.

    ``forecasts`` is (match_id, forecaster, picks_a, a_won). Equal votes count as a pick for a.
    """
    votes = forecasts.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("voters"),
        F.count_if("picks_a").alias("_for_a"),
        F.bool_or("a_won").alias("a_won"),
    )
    majority = F.greatest(F.col("_for_a"), F.col("voters") - F.col("_for_a"))
    picked_a = F.col("_for_a") * 2 >= F.col("voters")
    return (
        votes.withColumn("majority", majority)
        .groupBy("voters", "majority")
        .agg(
            F.count(F.lit(1)).alias("matches"),
            F.count_if(picked_a == F.col("a_won")).alias("hits"),
        )
        .withColumn("hit_rate", F.col("hits") / F.col("matches"))
    )


def cold_start(predictions: DataFrame) -> DataFrame:
    """Share of predictions without any rating signal, and quality with and without one."""
    split = predictions.withColumn("has_signal", F.col("p_a") != 0.5)
    return metrics(split, ["has_signal"])
