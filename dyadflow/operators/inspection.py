"""Read-only views of stored runs: report, explanation of one prediction, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.operators import evidence, ledger as lg
from dyadflow.operators import features, stats
from dyadflow.operators.folds import fold_members
from dyadflow.operators.ledger import Ledger
from dyadflow.operators.protocols import ProtocolStore


def _run(ledger: Ledger, run_id: int):
    row = ledger.runs().where(F.col("run_id") == run_id).first()
    if row is None:
        raise ValueError(f"experiment run {run_id} does not exist")
    return row


def _of(ledger: Ledger, table: str, run_id: int) -> DataFrame:
    return ledger.read(table).where(F.col("run_id") == run_id)


def run_report(
    ledger: Ledger, store: ProtocolStore, protocol_name: str, run_id: int, matches: DataFrame
) -> dict[str, DataFrame]:
    """The persisted basis of a run, section by section; nothing is refitted."""
    run = _run(ledger, run_id)
    protocol = store.get(protocol_name)
    if protocol.protocol_id != run["protocol_id"]:
        raise ValueError(f"run {run_id} is not on protocol {protocol_name!r}")
    placed, plan = store.load(protocol, matches)
    members = fold_members(plan, placed)
    predictions = _of(ledger, "predictions", run_id).drop("run_id")
    kind, definition = lg.FEATURE_SCHEMAS[run["feature_schema"]]
    described = ledger.runs().where(F.col("run_id") == run_id).select(
        "*",
        (~F.col("git_dirty")).alias("promotable"),
        F.lit(protocol.name).alias("protocol_name"),
        F.lit(protocol.kind).alias("protocol_kind"),
        F.lit(kind).alias("representation_kind"),
        F.lit(lg.definition_sha256(definition)).alias("definition_sha256"),
    )
    return {
        "run": described,
        "manifest": _of(ledger, "manifests", run_id),
        "model": _of(ledger, "models", run_id),
        "folds": lg.fold_report(members, matches, predictions),
        "predictions": lg.outcomes(predictions, matches),
    }


def known_at_cutoff(rows: DataFrame, matches: DataFrame, target: DataFrame) -> DataFrame:
    """Matches of the target's two athletes that its fold was trained on, by the stored input rows."""
    folds = rows.where(F.col("role") == "test").join(target.select("match_id"), "match_id", "left_semi")
    trained = rows.where(F.col("role") == "train").join(folds.select("fold_index"), "fold_index", "left_semi")
    both = target.select(F.explode(F.array("athlete_a_id", "athlete_b_id")).alias("_who")).distinct()
    ids = [r["_who"] for r in both.collect()]  # of one match
    theirs = F.col("athlete_a_id").isin(ids) | F.col("athlete_b_id").isin(ids)
    return matches.where(theirs).join(trained.select("match_id"), "match_id", "left_semi")


def history_counts(known: DataFrame, target: DataFrame) -> DataFrame:
    """(match_id, prior_matches_a, prior_matches_b, prior_meetings) of the target over known matches."""
    sources = features.full_provenance(known, target)
    count = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    return target.select("match_id").join(sources, "match_id", "left").groupBy("match_id").agg(
        *[count(F.col("side") == s).alias(f"prior_matches_{s}") for s in "ab"],
        count((F.col("side") == "a") & F.col("in_head_to_head")).alias("prior_meetings"),
    )


def explain_prediction(
    ledger: Ledger,
    run_id: int,
    match_id: int,
    matches: DataFrame,
    claims: DataFrame | None = None,
    subjects: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """What one stored prediction rests on: inputs with their cutoff, features without any source,
    outcomes, and, when claims are given, every claim with the reason it did or did not count."""
    _run(ledger, run_id)
    rows = _of(ledger, "feature_rows", run_id)
    inputs = rows.where((F.col("match_id") == match_id) & (F.col("role") == "test"))
    if inputs.isEmpty():
        raise ValueError(f"run {run_id} has no persisted test input for match {match_id}")
    cutoffs = lg.fold_cutoffs(rows.select("fold_index", "role", "match_id"), matches)
    target = matches.where(F.col("match_id") == match_id)
    known = known_at_cutoff(rows, matches, target)
    sections = {
        "inputs": inputs.join(cutoffs, "fold_index", "left"),
        "defaulted": lg.defaulted_features(history_counts(known, target)),
        "sources": features.full_provenance(known, target),
        "predictions": lg.outcomes(
            _of(ledger, "predictions", run_id).where(F.col("match_id") == match_id), matches
        ),
    }
    if claims is not None:
        sections["claims"] = evidence.describe_claims(target, claims, subjects)
    return sections


def compare_runs(
    ledger: Ledger,
    run_a: int,
    run_b: int,
    matches: DataFrame,
    restrict: DataFrame | None = None,
) -> DataFrame:
    """Paired comparison of two stored runs of one protocol, optionally on some matches only."""
    a, b = _run(ledger, run_a), _run(ledger, run_b)
    return stats.compare_runs(
        matches, _of(ledger, "predictions", run_a), _of(ledger, "predictions", run_b),
        a["protocol_id"], b["protocol_id"], restrict,
    )
