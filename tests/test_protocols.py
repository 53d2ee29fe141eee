import random

import pytest
from pyspark.sql import functions as F

from dyadflow.operators import folds, models, ratings
from dyadflow.operators.ledger import Ledger
from dyadflow.operators.protocols import ProtocolStore, evaluate_lockbox
from tests.helpers import match, matches, random_matches


def _events(df):
    return df.select("event_id", "held_on").distinct()


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "event_id long")


@pytest.fixture
def store(spark, tmp_path):
    return ProtocolStore(spark, str(tmp_path / "protocols"))


def test_rolling_origin_needs_a_lockbox_and_is_created_once(spark, store):
    df = matches(spark, random_matches(random.Random(21), 60))
    with pytest.raises(ValueError, match="lockbox"):
        store.rolling_origin("dev", 2, _events(df), df)
    store.seed_lockbox("box", "lockbox_retrospective", _events(df), df, _ids(spark, 6, 7))
    made = store.rolling_origin("dev", 2, _events(df), df)
    assert store.rolling_origin("dev", 5, _events(df), df) == made
    placed, plan = store.load(made, df)
    members = folds.fold_members(plan, placed)
    assert members.join(df.where("event_id >= 6"), "match_id").isEmpty()
    # matches that arrive later do not change the protocol
    more = df.unionByName(matches(spark, [match(5000, 1, 1, 2, event=0)]))
    again = folds.fold_members(*reversed(store.load(made, more)))
    assert again.count() == members.count()


def test_nothing_inside_a_lockbox_informs_its_predictions(spark, store, tmp_path):
    rows = [match(1, 0, 1, 2, "win", event=0), match(2, 10, 1, 2, "win", event=1), match(3, 20, 1, 2, "win", event=2), match(4, 15, 1, 2, "win", event=5)]
    df = matches(spark, rows)
    box = store.seed_lockbox("box", "lockbox_retrospective", _events(df), df, _ids(spark, 1, 2))
    placed, plan = store.load(box, df)
    run = models.elo_family().run(placed, plan)
    got = {r["match_id"]: r["p_a"] for r in run.predictions.collect()}
    assert set(got) == {2, 3} and got[2] == got[3]
    only = ratings.elo_history(matches(spark, rows[:1])).first()
    expected = 1 / (1 + 10 ** ((only["post_rating_b"] - only["post_rating_a"]) / 400))
    assert got[2] == pytest.approx(expected)


def test_consulting_a_lockbox(spark, store, tmp_path):
    df = matches(spark, random_matches(random.Random(22), 50))
    store.seed_lockbox("box", "lockbox_prospective", _events(df), df, _ids(spark, 6))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    args = dict(feature_schema="outcomes_elo_v1", git_sha="s")
    call = lambda run, **k: evaluate_lockbox(store, ledger, "box", run, "elo", models.elo_family(), df, **args, **k)
    with pytest.raises(RuntimeError):
        call(1, git_dirty=True)
    dry = call(1, git_dirty=False, dry_run=True)
    assert dry["run_id"] is None and dry["consultations_after"] == 0
    assert dry["test_match_count"] == df.where("event_id = 6").count()
    assert call(1, git_dirty=False)["consultations_after"] == 1
    assert call(2, git_dirty=False)["consultations_before"] == 1


def test_growing_a_lockbox(spark, store):
    df = matches(spark, random_matches(random.Random(23), 50))
    first = store.seed_lockbox("box", "lockbox_prospective", _events(df), df, _ids(spark, 6))
    late = df.unionByName(matches(spark, [match(5000, 1, 1, 2, event=0)]))
    grown = store.grow("box", 7, late)
    assert grown.spec == {"event_ids": [6, 7]} and grown.protocol_id != first.protocol_id
    assert store.grow("box", 7, late) == grown
    _, plan = store.load(grown, late)
    fold = plan.where("fold_index = 0").first()
    assert fold["test_count"] == df.where("event_id >= 6").count()
    assert fold["train_count"] == df.where("event_id < 6").count()
    store.seed_lockbox("old", "lockbox_retrospective", _events(df), df, _ids(spark, 5))
    with pytest.raises(ValueError):
        store.grow("old", 7, df)
    with pytest.raises(ValueError):
        store.seed_lockbox("old", "lockbox_retrospective", _events(df), df, _ids(spark, 5))
    with pytest.raises(ValueError):
        store.get("nothing")
    assert store.lockbox_event_ids() == [5, 6, 7]
