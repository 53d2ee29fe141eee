"""Small hand-made inputs shared by the tests."""

import datetime as dt

MATCH_SCHEMA = (
    "match_id long, event_id long, held_on date, scheduled_at timestamp, arm string, "
    "weight_class string, athlete_a_id long, athlete_b_id long, result_a string"
)


def match(match_id, day, a, b, result="win", event=None, arm="right", weight="105 kg"):
    """``day`` counts from 2026-01-01; the lower id must be side a."""
    when = dt.datetime(2026, 1, 1) + dt.timedelta(days=day)
    return (match_id, event if event is not None else day, when.date(), when, arm, weight, a, b, result)


def matches(spark, rows):
    return spark.createDataFrame(rows, MATCH_SCHEMA)


def random_matches(rng, n, athletes=12, events=8, hot=0.0):
    """Random history; with probability ``hot`` side a is athlete 0."""
    rows = []
    for i in range(n):
        a, b = sorted(rng.sample(range(athletes), 2))
        if rng.random() < hot:
            a, b = 0, rng.randrange(1, athletes)
        day = rng.randrange(events * 3)
        rows.append(match(1000 - i, day, a, b, rng.choice(["win", "loss"]), event=day // 3))
    # the date of an event is its first day
    return [(*r[:2], dt.date(2026, 1, 1) + dt.timedelta(days=3 * r[1]), *r[3:]) for r in rows]
