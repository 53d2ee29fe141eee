"""Dossier documents, batch counts with skips, and explanations at a fold's cutoff."""

import pytest
from pyspark.sql import functions as F

from dyadflow.operators import claims, features, inspection, validation
from dyadflow.operators import mechanisms as mech
from tests.helpers import match, matches


def test_atoms_are_nested_with_an_empty_default(spark):
    base = spark.createDataFrame([(1,), (2,)], "evidence_index long")
    dims = spark.createDataFrame([(2, "x")], "evidence_index long, kind string")
    atoms = spark.createDataFrame([(1, "hook", "a1_2"), (1, None, "a1_1")], "evidence_index long, action string, atom_id string")
    rows = {r.evidence_index: r for r in mech.attach_nested(base, dims, atoms).collect()}
    assert [(a.atom_id, a.action) for a in rows[1].atoms] == [("a1_1", None), ("a1_2", "hook")]
    assert rows[2].atoms == [] and rows[2].kind == "x" and rows[1].kind is None


def test_dossier_documents_refuse_what_does_not_fit(spark):
    themes = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "dossier long, pos int, label string")
    cited = spark.createDataFrame([(2, 7)], "dossier long, evidence_index long")
    sections, order = {"themes": themes, "claims": cited}, {"themes": "pos", "claims": "evidence_index"}
    rows = {r.dossier: r for r in mech.dossier_documents(sections, ["dossier"], order).collect()}
    assert [t.label for t in rows[1].themes] == ["a", "b"] and rows[1].claims == [] and rows[2].themes == []
    with pytest.raises(ValueError):
        mech.dossier_documents(sections, ["dossier"], order, max_rows=1)


def test_batches_count_skips_and_sources(spark):
    rows = spark.createDataFrame([("b", [], True), ("b", ["x"], False), ("b", [], None)], "f string, problems array<string>, skip boolean")
    got = validation.outcome_counts(rows, ["f"], F.col("skip")).first()
    assert (got.selected, got.completed, got.failed, got.skipped) == (3, 1, 1, 1)
    brought = spark.createDataFrame([("b", 1), ("b", 1), ("b", None)], "batch_key string, source_id long")
    assert tuple(claims.ingestion_summary(brought).first()) == ("b", 2, 3)


def test_an_explanation_rests_on_the_cutoff(spark):
    """Two matches of one event: the second's stored input knows nothing of the first."""
    df = matches(spark, [match(1, 0, 2, 3), match(2, 3, 1, 2, event=3), match(3, 3, 1, 2, event=3)])
    stored = spark.createDataFrame(
        [(0, "train", 1), (0, "test", 2), (0, "test", 3)], "fold_index long, role string, match_id long"
    )
    target = df.where("match_id = 3")
    known = inspection.known_at_cutoff(stored, df, target)
    assert [r.match_id for r in known.collect()] == [1]
    counts = inspection.history_counts(known, target).first()
    assert (counts.prior_matches_a, counts.prior_matches_b, counts.prior_meetings) == (0, 1, 0)
    row = features.cutoff_features(df).where("match_id = 3").first()
    assert (row.prior_matches_a, row.prior_matches_b, row.prior_meetings) == (0, 1, 0)
