import random

import pytest
from pyspark.sql import functions as F

from dyadflow.operators import folds, inspection, models
from dyadflow.operators.ledger import Ledger, rating_payloads, run_experiment
from dyadflow.operators.protocols import ProtocolStore
from tests.helpers import matches, random_matches


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    df = matches(spark, random_matches(random.Random(31), 60))
    events = df.select("event_id", "held_on").distinct()
    store, book = ProtocolStore(spark, f"{root}/protocols"), Ledger(spark, f"{root}/ledger")
    store.seed_lockbox("box", "lockbox_retrospective", events, df, spark.createDataFrame([(7,)], "event_id long"))
    dev = store.rolling_origin("dev", 4, events, df)
    placed, plan = store.load(dev, df)
    payloads = rating_payloads(folds.fold_members(plan, placed), placed)
    for run_id, family in ((1, models.elo_family()), (2, models.elo_family(64.0))):
        run_experiment(
            book, run_id, "elo", family, placed, plan, payloads, protocol_id=dev.protocol_id,
            feature_schema="outcomes_elo_v1", git_sha="abc", git_dirty=run_id == 2,
        )
    return df, store, book, plan


def test_report_shows_the_persisted_basis(world):
    df, store, book, plan = world
    report = inspection.run_report(book, store, "dev", 1, df)
    run = report["run"].first()
    assert run["promotable"] and run["protocol_name"] == "dev" and run["status"] == "completed"
    assert not inspection.run_report(book, store, "dev", 2, df)["run"].first()["promotable"]
    fold_rows = report["folds"].collect()
    assert all(r["test_count"] == r["predicted_match_count"] for r in fold_rows)
    assert len(fold_rows) == plan.where("fold_index IS NOT NULL").count()
    flipped = report["predictions"].groupBy("match_id").agg(F.array_sort(F.collect_list("outcome")).alias("o"))
    assert all(r["o"] == ["loss", "win"] for r in flipped.collect())
    assert report["manifest"].first()["feature_rows"] > 0 and report["model"].count() > 0
    with pytest.raises(ValueError):
        inspection.run_report(book, store, "box", 1, df)
    with pytest.raises(ValueError):
        inspection.run_report(book, store, "dev", 99, df)


def test_explanation_of_one_prediction(spark, world):
    df, _, book, _ = world
    match_id = book.read("predictions").where("run_id = 1").first()["match_id"]
    claims = spark.createDataFrame([(1, None), (2, None)], "claim_id long, published_at timestamp")
    target = df.where(F.col("match_id") == match_id).first()
    subjects = spark.createDataFrame([(1, target["athlete_a_id"]), (2, -5)], "claim_id long, athlete_id long")
    got = inspection.explain_prediction(book, 1, match_id, df, claims, subjects)
    row = got["inputs"].first()
    assert row["cutoff"] < target["scheduled_at"] and len(row["payload_sha256"]) == 64
    assert got["predictions"].count() == 2
    assert [r["excluded_reason"] for r in got["claims"].collect()] == ["unknown publication time"]
    assert got["defaulted"].count() == 1
    assert got["sources"].where("source_match_id = match_id").isEmpty()
    with pytest.raises(ValueError):
        inspection.explain_prediction(book, 1, -1, df)


def test_stored_runs_compare_on_shared_and_restricted_matches(spark, world):
    df, _, book, _ = world
    full = inspection.compare_runs(book, 1, 2, df).first()
    assert full["n"] == book.read("predictions").where("run_id = 1").select("match_id").distinct().count()
    assert full["ci_lower"] <= full["ci_upper"]
    few = book.read("predictions").where("run_id = 1").select("match_id").distinct().orderBy("match_id").limit(3)
    assert inspection.compare_runs(book, 1, 2, df, few).first()["n"] == 3
    same = inspection.compare_runs(book, 1, 1, df).first()
    assert same["mcnemar_p_value"] == 1.0 and not same["distinguishable"]
