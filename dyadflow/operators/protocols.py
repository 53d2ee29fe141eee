"""Evaluation protocols, materialised when they are created and never derived again.

A protocol keeps one row per event (its plan) and one row per match (which event it counted to), so
later matches cannot change what an earlier run was scored on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.operators import folds
from dyadflow.operators.ledger import (
    INPUTS,
    Ledger,
    evaluate_lockbox_gate,
    rating_payloads,
    run_experiment,
    with_inputs,
)

KINDS = ("rolling_origin", "lockbox_retrospective", "lockbox_prospective")


@dataclass(frozen=True)
class Protocol:
    protocol_id: int
    name: str
    kind: str
    spec: dict


def lockbox_plan(
    events: DataFrame, matches: DataFrame, chosen: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Matches and plan of a lockbox: everything before the freeze date against one test event.

    The chosen events are merged into a single one, so that nothing inside the lockbox can inform
    a prediction for another part of it.
    """
    ids = chosen.select("event_id").distinct()
    found = events.join(ids, "event_id", "left_semi")
    freeze, anchor, n_found = found.agg(
        F.min("held_on"), F.min("event_id"), F.count(F.lit(1))
    ).first()
    if n_found == 0 or n_found != ids.count():
        raise ValueError("a lockbox needs at least one event, and all of them must exist")
    early = events.where(F.col("held_on") < F.lit(freeze)).select("event_id", "held_on")
    dated = matches.drop("held_on")
    history = dated.join(early, "event_id")
    tested = (
        dated.join(ids, "event_id", "left_semi")
        .withColumn("event_id", F.lit(anchor))
        .withColumn("held_on", F.lit(freeze))
    )
    merged = history.unionByName(tested).select(*matches.columns)
    last = found.where(F.col("event_id") == anchor).select(
        "event_id", F.lit(freeze).alias("held_on")
    )
    plan = folds.rolling_origin(early.unionByName(last), merged, early.count())
    return merged, plan


class ProtocolStore:
    """Protocols under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing was written yet
            return None

    def find(self, name: str) -> Protocol | None:
        """Latest version of the protocol of that name."""
        stored = self._read("protocols")
        row = None if stored is None else stored.where(F.col("name") == name).orderBy(F.desc("version")).first()
        return None if row is None else Protocol(row["protocol_id"], row["name"], row["kind"], json.loads(row["spec"]))

    def get(self, name: str) -> Protocol:
        found = self.find(name)
        if found is None:
            raise ValueError(f"unknown protocol {name!r}")
        return found

    def _next(self, column: str, condition=None) -> int:
        stored = self._read("protocols")
        if stored is None:
            return 1
        rows = stored if condition is None else stored.where(condition)
        return (rows.agg(F.max(column)).first()[0] or 0) + 1

    def _save(self, name: str, kind: str, spec: dict, matches: DataFrame, plan: DataFrame) -> Protocol:
        if kind not in KINDS:
            raise ValueError(f"unknown protocol kind {kind!r}")
        number = self._next("protocol_id")
        version = self._next("version", F.col("name") == name)
        tag = F.lit(number).cast("long").alias("protocol_id")
        write = lambda df, what: df.write.mode("append").partitionBy("protocol_id").parquet(f"{self.root}/{what}")
        write(plan.select(tag, "*"), "plans")
        write(matches.select(tag, "match_id", "event_id", "held_on"), "placements")
        # the row that makes the protocol visible comes last
        self.spark.createDataFrame(
            [(number, version, name, kind, json.dumps(spec, sort_keys=True))],
            "protocol_id long, version long, name string, kind string, spec string",
        ).write.mode("append").parquet(f"{self.root}/protocols")
        return Protocol(number, name, kind, spec)

    def seed_lockbox(
        self, name: str, kind: str, events: DataFrame, matches: DataFrame, chosen: DataFrame
    ) -> Protocol:
        if not kind.startswith("lockbox"):
            raise ValueError(f"{kind!r} is not a lockbox kind")
        if self.find(name) is not None:
            raise ValueError(f"protocol {name!r} exists")
        merged, plan = lockbox_plan(events, matches, chosen)
        # the events of a lockbox are few and named by hand
        ids = sorted(r[0] for r in chosen.select("event_id").distinct().collect())
        return self._save(name, kind, {"event_ids": ids}, merged, plan)

    def grow(self, name: str, event_id: int, matches: DataFrame) -> Protocol:
        """Add one event's matches to a prospective lockbox; adding it again changes nothing.

        What the lockbox trains on stays as it was frozen.
        """
        old = self.get(name)
        if old.kind != "lockbox_prospective":
            raise ValueError(f"protocol {name!r} is not prospective")
        if event_id in old.spec["event_ids"]:
            return old
        placed, plan = self.load(old, matches)
        box = plan.orderBy(F.desc("position")).select("event_id", "held_on", "position").first()
        added = (
            matches.where(F.col("event_id") == event_id)
            .join(placed.select("match_id"), "match_id", "left_anti")
            .withColumn("event_id", F.lit(box["event_id"]))
            .withColumn("held_on", F.lit(box["held_on"]))
        )
        merged = placed.unionByName(added.select(*placed.columns))
        grown = folds.rolling_origin(plan.select("event_id", "held_on"), merged, box["position"])
        ids = [*old.spec["event_ids"], event_id]
        return self._save(name, old.kind, {"event_ids": ids}, merged, grown)

    def lockbox_event_ids(self) -> list[int]:
        stored = self._read("protocols")
        rows = [] if stored is None else stored.where(F.startswith("kind", F.lit("lockbox"))).collect()
        return sorted({i for r in rows for i in json.loads(r["spec"])["event_ids"]})

    def rolling_origin(
        self, name: str, min_training_events: int, events: DataFrame, matches: DataFrame
    ) -> Protocol:
        """The protocol of that name, created now if there is none.

        It needs a lockbox first, and leaves every lockbox event out of training and testing.
        """
        found = self.find(name)
        if found is not None:
            return found
        boxed = self.lockbox_event_ids()
        if not boxed:
            raise ValueError("a lockbox protocol must be seeded before rolling-origin creation")
        excluded = self.spark.createDataFrame([(i,) for i in boxed], "event_id long")
        plan = folds.rolling_origin(events, matches, min_training_events, excluded)
        kept = matches.join(plan.select("event_id"), "event_id", "left_semi")
        return self._save(name, "rolling_origin", {"min_training_events": min_training_events}, kept, plan)

    def load(self, protocol: Protocol, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Matches of the protocol, placed as they were when it was created, and its plan."""
        mine = F.col("protocol_id") == protocol.protocol_id
        placed = self._read("placements").where(mine).drop("protocol_id")
        plan = self._read("plans").where(mine).drop("protocol_id")
        current = matches.drop("event_id", "held_on").join(placed, "match_id")
        return current.select(*matches.columns), plan


def evaluate_lockbox(
    store: ProtocolStore,
    ledger: Ledger,
    name: str,
    run_id: int,
    family_name: str,
    family,
    matches: DataFrame,
    *,
    feature_schema: str,
    git_sha: str,
    git_dirty: bool,
    dry_run: bool = False,
) -> dict:
    """Spend one consultation of a lockbox, or with ``dry_run`` only show what would be evaluated."""
    protocol = store.get(name)
    evaluate_lockbox_gate(protocol.kind, git_dirty)
    placed, plan = store.load(protocol, matches)
    try:
        before = ledger.runs().where(F.col("protocol_id") == protocol.protocol_id).count()
    except AnalysisException:  # empty ledger
        before = 0
    fold = plan.where("fold_index = 0").select("train_count", "test_count").first()
    result = {
        "protocol_id": protocol.protocol_id,
        "train_match_count": fold["train_count"] if fold else 0,
        "test_match_count": fold["test_count"] if fold else 0,
        "consultations_before": before,
        "consultations_after": before,
        "run_id": None,
    }
    if dry_run:
        return result
    payloads = rating_payloads(folds.fold_members(plan, with_inputs(placed), *INPUTS))
    run_experiment(
        ledger, run_id, family_name, family, placed, plan, payloads,
        protocol_id=protocol.protocol_id, feature_schema=feature_schema, git_sha=git_sha,
        git_dirty=git_dirty,
    )
    return result | {"run_id": run_id, "consultations_after": before + 1}
