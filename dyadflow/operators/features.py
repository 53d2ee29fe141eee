"""Point-in-time features: every value comes from strictly earlier matches only.

``history_features`` gives one row per match as of that match (training rows).
``cutoff_features`` gives one row per match as of the start of its event (test rows): nothing
that happened inside the event is visible. Both are built from aggregates that carry over, so
neither replays history per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.functions import vocab
from dyadflow.operators.dyads import MATCH_ORDER, per_side, sides
from dyadflow.operators.running import LastK, running_before

EVENT_ORDER = ["held_on", "event_id"]
PAIR = ["athlete_a_id", "athlete_b_id"]
K = vocab.RECENT_FORM_WINDOW
_LAST_FIELDS = ("match_id", "won", "scheduled_at")


def _win_rate(wins: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(wins) / F.col(n)).otherwise(vocab.DEFAULT_WIN_RATE)


def _recent_form(last: Column) -> Column:
    total = F.aggregate(last, F.lit(0.0), lambda acc, s: acc + s["won"])
    return F.when(F.size(last) > 0, total / F.size(last)).otherwise(vocab.DEFAULT_WIN_RATE)


def _days_since(last: Column) -> Column:
    previous = F.try_element_at(last, F.lit(-1))["scheduled_at"]
    micros = F.unix_micros("scheduled_at") - F.unix_micros(previous)
    return F.coalesce(micros / F.lit(86_400_000_000), F.lit(vocab.DEBUT_DAYS))


def _sign() -> Column:
    return F.when(F.col("result_a") == "win", 1.0).otherwise(-1.0)


def head_to_head(matches: DataFrame, max_rows_per_task: int | None = None) -> DataFrame:
    """Append ``head_to_head_diff``: wins of a minus wins of b in earlier meetings."""
    return running_before(
        matches, PAIR, MATCH_ORDER,
        sums={"head_to_head_diff": _sign()},
        max_rows_per_task=max_rows_per_task,
    )


def athlete_history(
    matches: DataFrame, *extra: str, on_a: Sequence[str] = (), max_rows_per_task: int | None = None
) -> DataFrame:
    """Long form with win rate, recent form, days since the last match and the ids they rest on."""
    history = running_before(
        sides(matches, *extra, on_a=on_a), ["athlete_id"], MATCH_ORDER,
        sums={"_n": F.lit(1), "_wins": "won"},
        last={"_last": LastK(_LAST_FIELDS, K)},
        max_rows_per_task=max_rows_per_task,
    )
    last = F.col("_last")
    return history.select(
        *MATCH_ORDER, *extra, *on_a, "side", "athlete_id", "opponent_id", "won",
        F.col("_n").alias("prior_matches"),
        _win_rate("_wins", "_n").alias("win_rate"),
        _recent_form(last).alias("recent_form"),
        _days_since(last).alias("days_since_last_match"),
        last["match_id"].alias("recent_match_ids"),
    )


def history_features(
    matches: DataFrame,
    ratings: DataFrame | None = None,
    default_ratings: DataFrame | None = None,
    max_rows_per_task: int | None = None,
) -> DataFrame:
    """Feature row per match as of that match, label included.

    ``ratings`` is the output of ``ratings.elo_history``; without it the rating columns are left
    out. ``default_ratings`` (athlete_id, rating) replaces the start value of athletes that have
    no earlier match.
    """
    keep = ("arm", "weight_class", "result_a", "head_to_head_diff")
    long = athlete_history(
        head_to_head(matches, max_rows_per_task), on_a=keep, max_rows_per_task=max_rows_per_task
    )
    wide = long.groupBy("match_id").agg(
        *[per_side(c, "a").alias(c) for c in (*MATCH_ORDER[:3], *keep)],
        *[
            per_side(c, s)
            for c in (
                "athlete_id", "prior_matches", "win_rate", "recent_form", "days_since_last_match",
            )
            for s in "ab"
        ],
    )
    wide = wide.withColumn("label", F.when(F.col("result_a") == "win", 1.0).otherwise(0.0))
    if ratings is None:
        return wide
    joined = wide.join(ratings.select("match_id", "prior_rating_a", "prior_rating_b"), "match_id")
    return with_default_ratings(joined, default_ratings)


def with_default_ratings(features: DataFrame, default_ratings: DataFrame | None) -> DataFrame:
    """Debuting athletes take the supplied rating; known athletes keep their current one."""
    if default_ratings is None:
        return features
    for side in "ab":
        supplied = default_ratings.select(
            F.col("athlete_id").alias(f"athlete_id_{side}"), F.col("rating").alias("_default")
        )
        features = (
            features.join(supplied, f"athlete_id_{side}", "left")
            .withColumn(
                f"prior_rating_{side}",
                F.when(
                    F.col(f"prior_matches_{side}") == 0,
                    F.coalesce("_default", f"prior_rating_{side}"),
                ).otherwise(F.col(f"prior_rating_{side}")),
            )
            .drop("_default")
        )
    return features


def event_count(matches: DataFrame) -> int:
    """Number of events, which bounds the rows of anything reduced to one row per event."""
    return matches.agg(F.count_distinct(*EVENT_ORDER)).first()[0]


def _event_state(matches: DataFrame, max_rows_per_task: int | None, n_events: int) -> DataFrame:
    """State of every athlete before each event they take part in.

    Matches are first reduced to one row per athlete and event, and to the last five of each
    event by a top-k that is applied before the shuffle as well, so a hot athlete costs no more
    than the number of events.
    """
    long = sides(matches)
    by_event = ["athlete_id", *EVENT_ORDER]
    newest = Window.partitionBy(*by_event).orderBy(F.desc("scheduled_at"), F.desc("match_id"))
    totals = long.groupBy(*by_event).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("won").alias("_wins")
    )
    tails = (
        long.withColumn("_r", F.row_number().over(newest))
        .where(F.col("_r") <= K)
        .groupBy(*by_event)
        .agg(F.sort_array(F.collect_list(F.struct("scheduled_at", "match_id", "won"))).alias("_tail"))
    )
    state = running_before(
        totals.join(tails, by_event), ["athlete_id"], EVENT_ORDER,
        sums={"_before": "_n", "_before_wins": "_wins"},
        last={"_tails": LastK(("_tail",), K)},
        max_rows_per_task=max_rows_per_task,
        group_bound=n_events,
    )
    merged = F.flatten(F.col("_tails")["_tail"])
    start = F.greatest(F.size(merged) - F.lit(K - 1), F.lit(1))
    return state.select(
        *by_event, "_before", "_before_wins", F.slice(merged, start, F.lit(K)).alias("_last")
    )


def cutoff_features(matches: DataFrame, max_rows_per_task: int | None = None) -> DataFrame:
    """Feature row per match as of the state before its event."""
    keep = ("arm", "weight_class", "result_a")
    n_events = event_count(matches)
    pair_events = running_before(
        matches.groupBy(*PAIR, *EVENT_ORDER).agg(
            F.sum(_sign()).alias("_diff"), F.count(F.lit(1)).alias("_met")
        ),
        PAIR, EVENT_ORDER,
        sums={"head_to_head_diff": "_diff", "prior_meetings": "_met"},
        max_rows_per_task=max_rows_per_task,
        group_bound=n_events,
    ).drop("_diff", "_met")
    with_pair = matches.join(pair_events, [*PAIR, *EVENT_ORDER])
    long = sides(with_pair, on_a=(*keep, "head_to_head_diff", "prior_meetings")).join(
        _event_state(matches, max_rows_per_task, n_events), ["athlete_id", *EVENT_ORDER]
    )
    last = F.col("_last")
    valued = long.select(
        *MATCH_ORDER, *keep, "head_to_head_diff", "prior_meetings", "side", "athlete_id",
        F.col("_before").alias("prior_matches"),
        _win_rate("_before_wins", "_before").alias("win_rate"),
        _recent_form(last).alias("recent_form"),
        _days_since(last).alias("days_since_last_match"),
    )
    return valued.groupBy("match_id").agg(
        *[per_side(c, "a").alias(c) for c in (*MATCH_ORDER[:3], *keep, "head_to_head_diff", "prior_meetings")],
        *[
            per_side(c, s)
            for c in (
                "athlete_id", "prior_matches", "win_rate", "recent_form", "days_since_last_match",
            )
            for s in "ab"
        ],
    )


def full_provenance(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Every earlier match behind the features of the given target matches, as flat rows.

    Meant for the matches somebody wants explained; the bounded lists that come with
    ``athlete_history`` are enough for everything else.
    """
    long = sides(matches)
    wanted = sides(targets).select(
        *[F.col(c).alias(f"_t_{c}") for c in MATCH_ORDER], "side", "athlete_id",
        F.col("opponent_id").alias("_t_opponent"),
    )
    earlier = F.struct(*MATCH_ORDER) < F.struct(*[F.col(f"_t_{c}").alias(c) for c in MATCH_ORDER])
    return (
        long.drop("side", "won")
        .join(wanted, "athlete_id")
        .where(earlier)
        .select(
            F.col("_t_match_id").alias("match_id"),
            "side",
            "athlete_id",
            F.col("match_id").alias("source_match_id"),
            (F.col("opponent_id") == F.col("_t_opponent")).alias("in_head_to_head"),
        )
    )
