"""Leakage, hand-computed values and agreement with a plain replay of history."""

import random

import pytest
from pyspark.sql import functions as F

from dyadflow.operators import features, ratings
from dyadflow.operators.dyads import sides
from tests.helpers import match, matches, random_matches


def _rows(df, key="match_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def _with_ratings(df):
    return features.history_features(df, ratings.elo_history(df))


def test_later_rematch_never_changes_an_earlier_row(spark):
    january = [match(1, 0, 1, 2, "win")]
    both = january + [match(2, 150, 1, 2, "loss")]
    first = _rows(_with_ratings(matches(spark, january)))[1]
    again = _rows(_with_ratings(matches(spark, both)))[1]
    assert first == again
    assert first["prior_rating_a"] == 1500.0 and first["win_rate_a"] == 0.5
    assert first["days_since_last_match_a"] == -1.0 and first["head_to_head_diff"] == 0.0


def test_leakage_check_bites_on_a_broken_variant(spark):
    rows = matches(spark, [match(1, 0, 1, 2, "win"), match(2, 150, 1, 2, "loss")])
    # one number for the whole window instead of one per row
    total = rows.agg(F.sum(F.when(F.col("result_a") == "win", 1).otherwise(-1))).first()[0]
    honest = _rows(features.head_to_head(rows))[2]["head_to_head_diff"]
    assert honest != total


def test_head_to_head_over_three_meetings(spark):
    df = matches(spark, [match(1, 0, 1, 2, "win"), match(2, 10, 1, 2, "win"), match(3, 20, 1, 2, "loss")])
    got = _rows(features.head_to_head(df))
    assert [got[i]["head_to_head_diff"] for i in (1, 2, 3)] == [0.0, 1.0, 2.0]


def test_recent_form_sees_only_the_last_five(spark):
    results = ["win", "loss", "loss", "win", "win", "win", "win"]
    df = matches(spark, [match(i + 1, i * 10, 1, 10 + i, r) for i, r in enumerate(results)])
    seventh = _rows(features.athlete_history(df).where("athlete_id = 1"))[7]
    assert seventh["recent_match_ids"] == [2, 3, 4, 5, 6]
    assert seventh["recent_form"] == pytest.approx(3 / 5)
    assert seventh["win_rate"] == pytest.approx(4 / 6)
    assert seventh["days_since_last_match"] == 10.0


def test_sources_are_strictly_earlier(spark):
    df = matches(spark, random_matches(random.Random(3), 80))
    when = {r["match_id"]: (r["held_on"], r["event_id"], r["scheduled_at"], r["match_id"]) for r in df.collect()}
    for r in features.athlete_history(df).collect():
        assert all(when[i] < when[r["match_id"]] for i in r["recent_match_ids"])
    explained = features.full_provenance(df, df)
    assert all(when[r["source_match_id"]] < when[r["match_id"]] for r in explained.collect())


def _replay(rows):
    """Row-by-row oracle for both kinds of features."""
    rows = sorted(rows, key=lambda r: (r[2], r[1], r[3], r[0]))
    seen, sequential, cutoff = [], {}, {}
    event_start = {}
    for i, r in enumerate(rows):
        event_start.setdefault(r[1], i)

    def state(row, before):
        out = {}
        for side, me in (("a", row[6]), ("b", row[7])):
            mine = [x for x in before if me in (x[6], x[7])]
            won = [float((x[8] == "win") == (x[6] == me)) for x in mine]
            out[f"win_rate_{side}"] = sum(won) / len(won) if won else 0.5
            out[f"recent_form_{side}"] = sum(won[-5:]) / len(won[-5:]) if won else 0.5
            out[f"days_since_last_match_{side}"] = (
                (row[3] - mine[-1][3]).total_seconds() / 86400 if mine else -1.0
            )
        pair = [x for x in before if (x[6], x[7]) == (row[6], row[7])]
        out["head_to_head_diff"] = float(sum(1 if x[8] == "win" else -1 for x in pair))
        return out

    for r in rows:
        sequential[r[0]] = state(r, seen)
        cutoff[r[0]] = state(r, rows[: event_start[r[1]]])
        seen.append(r)
    return sequential, cutoff


@pytest.mark.parametrize("limit", [None, 20])
@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_features_match_a_replay_of_history(spark, limit, hot):
    rows = random_matches(random.Random(11), 150, hot=hot)
    df = matches(spark, rows)
    sequential, cutoff = _replay(rows)
    for want, got in (
        (sequential, _rows(features.history_features(df, max_rows_per_task=limit))),
        (cutoff, _rows(features.cutoff_features(df, max_rows_per_task=limit))),
    ):
        assert want.keys() == got.keys()
        for match_id, values in want.items():
            for name, value in values.items():
                assert got[match_id][name] == pytest.approx(value), (match_id, name)


def test_deleting_the_future_changes_nothing(spark):
    rows = sorted(random_matches(random.Random(5), 60), key=lambda r: (r[2], r[1], r[3], r[0]))
    full = _rows(_with_ratings(matches(spark, rows)))
    part = _rows(_with_ratings(matches(spark, rows[:30])))
    assert all(full[k] == v for k, v in part.items())


def test_default_ratings_only_replace_debut_values(spark):
    df = matches(spark, [match(1, 0, 1, 2), match(2, 5, 1, 3)])
    supplied = spark.createDataFrame([(1, 1800.0), (3, 1300.0)], "athlete_id long, rating double")
    got = _rows(features.history_features(df, ratings.elo_history(df), supplied))
    assert got[1]["prior_rating_a"] == 1800.0 and got[1]["prior_rating_b"] == 1500.0
    assert got[2]["prior_rating_a"] == 1512.0 and got[2]["prior_rating_b"] == 1300.0


def test_columns_of_a_match_travel_once(spark):
    df = matches(spark, [match(1, 0, 1, 2, arm="left"), match(2, 1, 1, 3, "loss")])
    rows = {(r["match_id"], r["side"]): (r["arm"], r["result_a"]) for r in sides(df, on_a=("arm", "result_a")).collect()}
    assert rows == {(1, "a"): ("left", "win"), (1, "b"): (None, None), (2, "a"): ("right", "loss"), (2, "b"): (None, None)}
