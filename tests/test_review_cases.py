"""Inputs that earlier fixtures did not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dyadflow.functions import text, vocab
from dyadflow.operators import evidence, models, validation


def test_files_are_checked_apart_and_odd_lines_rejected(spark):
    good = {
        "event_slug": "e", "event_name": "E", "event_date": "2024-01-01", "promoter": "p", "arm": "left",
        "weight_class": "w", "athlete_a": "A", "athlete_b": "B", "score_a": "3", "score_b": "1",
        "status": "completed", "video_id": "", "bout": "",
    }
    schema = ", ".join(f"{c} string" for c in ["batch_key", *vocab.RESULT_COLUMNS, "_corrupt"])
    line = lambda file, corrupt=None: (file, *[good[c] for c in vocab.RESULT_COLUMNS], corrupt)
    rows = spark.createDataFrame([line("f1"), line("f2"), line("f3", "a,b"), line("f4"), line("f4")], schema)
    got = {}
    for r in validation.validate_results(rows).collect():
        got.setdefault(r.batch_key, []).append(list(r.problems))
    assert got["f1"] == got["f2"] == [[]]
    assert got["f3"] == [["wrong number of columns"]]
    assert all("repeated same-day" in p[0] for p in got["f4"])


def test_a_claim_with_three_subjects_counts_once(spark):
    when = dt.datetime(2020, 1, 1)
    claims = spark.createDataFrame([(1, when, "tactic")], "claim_id long, published_at timestamp, claim_type string")
    subjects = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "claim_id long, athlete_id long")
    pairs = [(10 * a + b, dt.datetime(2021, 1, 1), a, b) for a, b in ((1, 2), (1, 3), (2, 3))]
    matches = spark.createDataFrame(
        pairs, "match_id long, scheduled_at timestamp, athlete_a_id long, athlete_b_id long"
    )
    encoded = evidence.encode(matches, claims, subjects)
    counts = [c for c in encoded.columns if "eligible" in c or "claim" in c]
    rows = encoded.select("match_id", *counts).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1
    assert all(value == 1 for value in tuple(rows[0])[1:])


def test_evidence_family_needs_evidence():
    with pytest.raises(ValueError, match="evidence"):
        models.resolve_family("evidence_v1")


def test_weights_behind_a_word(spark):
    row = spark.range(1).select(text.kg_values(F.lit("around80kg, nearly 82-85 kg, 90 kg")).alias("v")).first()
    assert row.v == ["80", "82-85", "90"]
