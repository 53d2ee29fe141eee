"""Time-safe evaluation folds.

A fold's training set is every match of an earlier eligible event, so membership is stored as one
position per match plus one position per fold, frozen when the protocol is created. The long
train/test listing can be produced from that at any time, but nothing has to keep folds x matches
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.operators.features import EVENT_ORDER
from dyadflow.operators.running import ordinal, running_before
from dyadflow.staging import stage


def rolling_origin(
    events: DataFrame,
    matches: DataFrame,
    min_training_events: int,
    excluded: DataFrame | None = None,
    max_rows_per_task: int | None = None,
) -> DataFrame:
    """One row per eligible event: its position, match counts, and its fold if it is tested.

    Events of ``excluded`` (event_id) are gone from training and testing alike. An event without
    completed matches keeps its position but gets no fold (``fold_index`` is null).
    """
    eligible = events.select(*EVENT_ORDER)
    if excluded is not None:
        eligible = eligible.join(excluded.select("event_id").distinct(), "event_id", "left_anti")
    sizes = matches.groupBy("event_id").agg(F.count(F.lit(1)).alias("test_count"))
    # one row per event, read several times below
    sized = stage(eligible.join(sizes, "event_id", "left").fillna({"test_count": 0}), "events")
    placed = running_before(
        sized, [], EVENT_ORDER,
        sums={"position": F.lit(1), "train_count": "test_count"},
        max_rows_per_task=max_rows_per_task,
    )
    tested = (F.col("position") >= min_training_events) & (F.col("test_count") > 0)
    numbered = running_before(
        placed.withColumn("_tested", tested.cast("long")), [], EVENT_ORDER,
        sums={"_before": "_tested"},
        max_rows_per_task=max_rows_per_task,
    )
    return numbered.select(
        *EVENT_ORDER, "position", "train_count", "test_count",
        F.when(F.col("_tested") == 1, F.col("_before")).alias("fold_index"),
        (F.col("_before") + F.col("_tested")).alias("first_train_fold"),
    )


def fold_members(plan: DataFrame, matches: DataFrame, *keep: str) -> DataFrame:
    """Long listing (fold_index, role, match_id) of a rolling-origin plan, with columns of ``matches`` to keep.

    A match's rows are made where the match is; what they carry needs no join with the listing, which
    has folds x matches rows.
    """
    folds = plan.agg(F.max("fold_index")).first()[0]
    placed = matches.select("match_id", "event_id", *keep).join(
        plan.select("event_id", "fold_index", "first_train_fold"), "event_id"
    )
    test = placed.where("fold_index IS NOT NULL").select(
        "fold_index", F.lit("test").alias("role"), "match_id", *keep
    )
    if folds is None:
        return test
    train = placed.where(F.col("first_train_fold") <= folds).select(
        F.explode(F.sequence("first_train_fold", F.lit(folds).cast("long"))).alias("fold_index"),
        F.lit("train").alias("role"),
        "match_id",
        *keep,
    )
    return train.unionByName(test)


def missing_slugs(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested slugs that no event has, each once."""
    return wanted.select("slug").distinct().join(events.select("slug"), "slug", "left_anti")


def resolve_events(events: DataFrame, slugs: list[str]) -> DataFrame:
    """Event rows for the given slugs; unknown slugs are an error."""
    spark = events.sparkSession
    wanted = spark.createDataFrame([(s,) for s in slugs], "slug string").distinct()
    missing = [r[0] for r in missing_slugs(events, wanted).collect()]
    if missing:
        raise ValueError(f"unknown event slugs: {sorted(missing)}")
    return events.join(wanted, "slug", "left_semi")


def lockbox(events: DataFrame, matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """The single fold of a lockbox: completed history before its first event against its events.

    The earliest date of the chosen events is the freeze date; one date comes to the driver.
    """
    found = events.join(chosen.select("event_id").distinct(), "event_id", "left_semi")
    freeze, n_found = found.agg(F.min("held_on"), F.count(F.lit(1))).first()
    n_chosen = chosen.select("event_id").distinct().count()
    if n_chosen == 0:
        raise ValueError("at least one lockbox event is required")
    if n_found != n_chosen:
        raise ValueError("one or more lockbox events do not exist")
    rows = matches.drop("held_on").join(events.select("event_id", "held_on"), "event_id")
    train = rows.where(F.col("held_on") < F.lit(freeze)).select(
        F.lit("train").alias("role"), "match_id"
    )
    test = rows.join(found.select("event_id"), "event_id", "left_semi").select(
        F.lit("test").alias("role"), "match_id"
    )
    return train.unionByName(test).withColumn("fold_index", F.lit(0).cast("long"))


def lockbox_events(members: DataFrame, matches: DataFrame) -> DataFrame:
    """Events that any lockbox tests on; these stay out of every rolling-origin protocol."""
    tests = members.where(F.col("role") == "test").select("match_id")
    return matches.join(tests, "match_id", "left_semi").select("event_id").distinct()


def grow_prospective(
    members: DataFrame, all_matches: DataFrame, event_id: int, max_rows_per_task: int | None = None
) -> DataFrame:
    """Append one event's matches, whatever their status, to an ordered prospective test list.

    ``members`` is (match_id, seq). Matches already listed keep their place, so growing by the same
    event twice changes nothing.
    """
    last = members.agg(F.max("seq")).first()[0]
    start = 0 if last is None else last + 1
    unseen = (
        all_matches.where(F.col("event_id") == event_id)
        .select("match_id")
        .distinct()
        .join(members, "match_id", "left_anti")
    )
    added = ordinal(unseen, [], ["match_id"], "_n", max_rows_per_task).select(
        "match_id", (F.col("_n") + F.lit(start)).cast("long").alias("seq")
    )
    return members.select("match_id", F.col("seq").cast("long").alias("seq")).unionByName(added)


def require_lockbox(protocols: DataFrame) -> None:
    """A rolling-origin protocol may only be created once a lockbox exists."""
    if protocols.where(F.startswith("kind", F.lit("lockbox"))).isEmpty():
        raise ValueError("a lockbox protocol must be seeded before rolling-origin creation")
