"""Append-only experiment ledger: inputs, predictions, status, reports.

Tables are Parquet folders partitioned by run and attempt. A run's status is the latest of its status
rows, so nothing is updated in place. What an attempt wrote is visible once its completion is a status
row, which is one small write: before that, and for good if the attempt fails, readers do not see it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadflow.functions import vocab
from dyadflow.functions.text import canonical
from dyadflow.staging import release, stage

STATUS_SCHEMA = (
    "run_id long, attempt long, status string, seq long, at timestamp, git_sha string, git_dirty boolean, "
    "protocol_id long, feature_schema string, model_family string, hyperparams string, seed long, "
    "metrics string, error_message string"
)


def definition_sha256(definition: object) -> str:
    """Digest of a definition's JSON text with sorted keys and no spaces."""
    text = json.dumps(definition, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return hashlib.sha256(text.encode()).hexdigest()


FEATURE_SCHEMAS = {
    "outcomes_elo_v1": ("rating", vocab.OUTCOMES_DEFINITION),
    "history_v1": ("tabular", vocab.HISTORY_DEFINITION),
}


def require_compatible(feature_schema: str, kind: str) -> None:
    """Refuse a model that cannot consume the feature schema, before anything is written."""
    if feature_schema not in FEATURE_SCHEMAS:
        raise ValueError(f"unknown feature schema {feature_schema}")
    supported = FEATURE_SCHEMAS[feature_schema][0]
    if supported != kind:
        raise ValueError(f"feature schema {feature_schema!r} is for {supported} models, not {kind}")


def is_promotable(git_dirty: bool) -> bool:
    return not git_dirty


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """Two complementary rows per predicted match."""
    one = lambda athlete, p: F.struct(F.col(athlete).alias("athlete_id"), p.alias("p_win"))
    keep = [c for c in ("run_id", "fold_index", "match_id") if c in predictions.columns]
    both = F.array(one("athlete_a_id", F.col("p_a")), one("athlete_b_id", 1.0 - F.col("p_a")))
    return predictions.select(*keep, F.explode(both).alias("s")).select(*keep, "s.*")


def prediction_problems(rows: DataFrame) -> DataFrame:
    """Rows whose probability is missing or outside [0, 1]."""
    return rows.where(F.col("p_win").isNull() | (F.col("p_win") < 0) | (F.col("p_win") > 1))


#: What a match reads like as an input, by role; ``folds.fold_members`` can carry these along.
INPUTS = ("train_input", "test_input")


def with_inputs(matches: DataFrame) -> DataFrame:
    """``matches`` with ``INPUTS``, the payload and its digest in both forms a rating model takes a match in."""
    fields = {
        "match_id": F.col("match_id"),
        "scheduled_at": F.date_format("scheduled_at", "yyyy-MM-dd HH:mm:ss"),
        "arm": F.col("arm"),
        "athlete_a_id": F.col("athlete_a_id"),
        "athlete_b_id": F.col("athlete_b_id"),
        "missingness": F.lit("not_applicable"),
    }
    won = {"train": (F.col("result_a") == "win").cast("string"), "test": F.lit(None).cast("string")}
    texts = {role: canonical(fields | {"athlete_a_won": w}) for role, w in won.items()}
    return matches.withColumns({
        f"{role}_input": F.struct(text.alias("payload"), F.sha2(text, 256).alias("payload_sha256"))
        for role, text in texts.items()
    })


def _hashed_inputs(matches: DataFrame, *keep: str) -> DataFrame:
    """(keep, match_id, role, payload, payload_sha256): a row for each of a match's ``INPUTS``."""
    both = F.array(*[
        F.struct(F.lit(c.removesuffix("_input")).alias("role"), F.col(c).alias("input")) for c in INPUTS
    ])
    per_role = with_inputs(matches).select(*keep, "match_id", F.explode(both).alias("p"))
    return per_role.select(*keep, "match_id", "p.role", "p.input.*")


def rating_payloads(members: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Input row per (fold, role, match) of a rating model; only training rows carry the outcome.

    A training row reads the same in every fold, so it is built and hashed once per match. Members that
    carry ``INPUTS`` have all they need; any other listing is joined with its matches.
    """
    if set(INPUTS) <= set(members.columns):
        own = F.when(F.col("role") == "train", F.col("train_input")).otherwise(F.col("test_input"))
        return members.select("match_id", "role", "fold_index", own.alias("p")).select(
            "match_id", "role", "fold_index", "p.payload", "p.payload_sha256"
        )
    return members.select("fold_index", "role", "match_id").join(_hashed_inputs(matches), ["match_id", "role"])


def history_payloads(rows: DataFrame, role: str) -> DataFrame:
    """Input row of a tabular model: features, then the outcome or the time it is asked for."""
    fields = {
        c: F.format_string("%.6f", F.round(F.col(c).cast("double"), 6))
        for c in rows.columns
        if c.startswith(("prior_rating", "win_rate", "recent_form", "days_since", "head_to_head"))
        or c in ("evidence_count", "recent_injury_flag", "technique_advantage_flag")
    }
    fields |= {"arm": F.col("arm"), "weight_class": F.col("weight_class")}
    if role == "train":
        fields["label"] = F.format_string("%.1f", F.col("label"))
    else:
        fields["scheduled_at"] = F.date_format("scheduled_at", "yyyy-MM-dd HH:mm:ss")
    payload = canonical(fields)
    keep = [c for c in ("fold_index",) if c in rows.columns]
    return rows.select(
        *keep, F.lit(role).alias("role"), "match_id", payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_sha256"),
    )


#: A digest is added up in pieces of 15 hexadecimal digits; the fifth holds the last four of the 64.
PIECES = [f"_p{i}" for i in range(5)]


def _piece_sums() -> list:
    # a piece has 60 bits: its halves add up as plain longs, which is much quicker than decimals
    piece = lambda i: F.conv(F.substring("payload_sha256", 1 + 15 * i, 15), 16, 10).cast("long")
    half = F.lit(1 << 30).cast("decimal(20,0)")
    return [
        (F.sum(F.shiftright(piece(i), 30)).cast("decimal(20,0)") * half + F.sum(piece(i).bitwiseAND((1 << 30) - 1)))
        .cast("decimal(38,0)").alias(name)
        for i, name in enumerate(PIECES)
    ]


def _sealed(summed: DataFrame, *by: str) -> DataFrame:
    text = F.concat_ws("|", "feature_rows", *[F.col(p).cast("string") for p in PIECES])
    return summed.select(
        *by, "feature_rows", "train_rows", "test_rows", F.sha2(text, 256).alias("manifest_sha256")
    )


def manifest(payloads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Row counts per role and one digest over all input rows.

    Digest pieces are added up, so the result does not depend on row order and every task sends
    one partial sum instead of its list of hashes.
    """
    summed = payloads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("feature_rows"),
        F.count_if(F.col("role") == "train").alias("train_rows"),
        F.count_if(F.col("role") == "test").alias("test_rows"),
        *_piece_sums(),
    )
    return _sealed(summed, *by)


def rating_manifests(plan: DataFrame, matches: DataFrame) -> DataFrame:
    """``manifest`` of every fold of a plan, without listing its members.

    A training set is all events before the tested one, so the sums of each event, added up along the
    plan, give those of each fold: the matches are hashed once, and what is ordered is one row an event.
    """
    sums = _hashed_inputs(matches, "event_id").groupBy("event_id", "role").agg(
        F.count(F.lit(1)).alias("_n"), *_piece_sums()
    )
    of_role = lambda role: sums.where(F.col("role") == role).select(
        "event_id", *[F.col(c).alias(f"{role}{c}") for c in ("_n", *PIECES)]
    )
    along = plan.select("event_id", "position", "fold_index").join(of_role("train"), "event_id", "left")
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    folds = along.join(of_role("test"), "event_id", "left").select(
        "fold_index", "test_n", *[f"test{p}" for p in PIECES],
        *[F.coalesce(F.sum(f"train{c}").over(before), F.lit(0)).alias(f"train{c}") for c in ("_n", *PIECES)],
    )
    folds = folds.where("fold_index IS NOT NULL").select(
        "fold_index", F.col("train_n").alias("train_rows"), F.col("test_n").alias("test_rows"),
        (F.col("train_n") + F.col("test_n")).alias("feature_rows"),
        *[(F.col(f"train{p}") + F.col(f"test{p}")).cast("decimal(38,0)").alias(p) for p in PIECES],
    )
    return _sealed(folds, "fold_index")


def outcomes(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Stored predictions with the athlete's own outcome; null until the match is completed."""
    flipped = F.when(F.col("result_a") == "win", "loss").when(F.col("result_a") == "loss", "win")
    return predictions.join(
        matches.select("match_id", "athlete_a_id", "result_a"), "match_id", "left"
    ).select(
        *predictions.columns,
        F.when(F.col("athlete_id") == F.col("athlete_a_id"), F.col("result_a"))
        .otherwise(flipped)
        .alias("outcome"),
    )


def fold_report(members: DataFrame, matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per fold: test size, event dates tested, and how many test matches have a prediction."""
    tests = members.where(F.col("role") == "test").select("fold_index", "match_id")
    predicted = predictions.select("match_id").distinct().withColumn("_p", F.lit(1))
    joined = tests.join(matches.select("match_id", "held_on"), "match_id").join(
        predicted, "match_id", "left"
    )
    # dates of one fold: first reduced to one row per date, so the list is as long as its events
    per_date = joined.groupBy("fold_index", "held_on").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_p").alias("_hit")
    )
    return per_date.groupBy("fold_index").agg(
        F.sum("_n").alias("test_count"),
        F.sum("_hit").alias("predicted_match_count"),
        F.array_sort(F.collect_list("held_on")).alias("test_event_dates"),
    )


def fold_cutoffs(members: DataFrame, matches: DataFrame) -> DataFrame:
    """Latest training match per fold; null for a fold that trains on nothing."""
    folds = members.select("fold_index").distinct()
    last = (
        members.where(F.col("role") == "train")
        .join(matches.select("match_id", "scheduled_at"), "match_id")
        .groupBy("fold_index")
        .agg(F.max("scheduled_at").alias("cutoff"))
    )
    return folds.join(last, "fold_index", "left")


def plan_cutoffs(plan: DataFrame, matches: DataFrame) -> DataFrame:
    """``fold_cutoffs`` of a plan from one row per event, without listing the members."""
    last = matches.groupBy("event_id").agg(F.max("scheduled_at").alias("_last"))
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return (
        plan.select("event_id", "position", "fold_index").join(last, "event_id", "left")
        .withColumn("cutoff", F.max("_last").over(before))
        .where("fold_index IS NOT NULL").select("fold_index", "cutoff")
    )


def defaulted_features(rows: DataFrame) -> DataFrame:
    """Names of the features that rest on no earlier match, sorted."""
    per_side = [
        F.when(F.col(f"prior_matches_{s}") == 0, F.lit(f"{name}_{s}"))
        for s in "ab"
        for name in ("prior_rating", "recent_form", "win_rate", "days_since_last_match")
    ]
    pair = F.when(F.col("prior_meetings") == 0, F.lit("head_to_head_diff"))
    names = F.array_sort(F.array_compact(F.array(pair, *per_side)))
    return rows.select("match_id", names.alias("defaulted_features"))


def run_report(
    runs: DataFrame, protocols: DataFrame, specs: DataFrame, manifests: DataFrame, models: DataFrame
) -> DataFrame:
    """A run with its protocol, feature schema, manifest and, if fitted, its model."""
    return (
        runs.join(protocols, "protocol_id")
        .join(specs, "feature_spec_id")
        .join(manifests, "run_id")
        .join(models, "run_id", "left")
        .withColumn("promotable", ~F.col("git_dirty"))
    )


def consultations(runs: DataFrame, protocols: DataFrame, members: DataFrame) -> DataFrame:
    """Per protocol: how often it was run, and its fold membership totals."""
    counted = runs.groupBy("protocol_id").agg(F.count(F.lit(1)).alias("consultations"))
    sizes = members.groupBy("protocol_id").agg(
        F.count_if(F.col("role") == "train").alias("train_match_count"),
        F.count_if(F.col("role") == "test").alias("test_match_count"),
    )
    return (
        protocols.join(counted, "protocol_id", "left")
        .join(sizes, "protocol_id", "left")
        .fillna(0, ["consultations", "train_match_count", "test_match_count"])
    )


class Ledger:
    """The ledger's tables under one folder.

    A step of an attempt replaces what an earlier try of the same step left, so it can be repeated. An id
    is handed out or claimed once, by a marker file that only one caller can create (on a file system
    with exclusive creation); a failed run may be started again as its next attempt, any other may not.
    """

    TABLES = ("feature_rows", "manifests", "predictions", "models")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _claim(self, run_id: int, attempt: int) -> bool:
        """Whether this caller, and no other, owns the attempt."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{run_id}-{attempt}")
        try:
            return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(path)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise

    def _statuses(self) -> DataFrame:
        try:
            return self.spark.read.schema(STATUS_SCHEMA).parquet(f"{self.root}/status")
        except AnalysisException:  # no run yet
            return self.spark.createDataFrame([], STATUS_SCHEMA)

    def _state(self, run_id: int):
        """Newest status row of a run, or None."""
        return self._statuses().where(F.col("run_id") == run_id).orderBy(F.desc("seq")).first()

    def _status(self, run_id: int, attempt: int, status: str, seq: int, **values) -> None:
        row = {"run_id": run_id, "attempt": attempt, "status": status, "seq": seq, **values}
        names = [f.split()[0] for f in STATUS_SCHEMA.split(", ")]
        frame = self.spark.createDataFrame([tuple(row.get(n) for n in names)], STATUS_SCHEMA)
        stamped = frame.withColumn("at", F.current_timestamp())
        stamped.write.mode("append").partitionBy("run_id").parquet(f"{self.root}/status")

    def runs(self) -> DataFrame:
        """Current state of every run: what its newest attempt was started with, and how it went."""
        first = [
            "git_sha", "git_dirty", "protocol_id", "feature_schema", "model_family",
            "hyperparams", "seed",
        ]
        started = F.when(F.col("status") == "running", F.col("seq"))
        return self.read_statuses().groupBy("run_id").agg(
            F.max_by("status", "seq").alias("status"),
            F.max("attempt").alias("attempts"),
            *[F.max_by(c, started).alias(c) for c in first],
            *[F.max_by(c, "seq").alias(c) for c in ("metrics", "error_message")],
        )

    def read_statuses(self) -> DataFrame:
        return self.spark.read.schema(STATUS_SCHEMA).parquet(f"{self.root}/status")

    def read(self, name: str) -> DataFrame:
        """Rows of completed runs."""
        done = self.read_statuses().where("status = 'completed'").select("run_id", "attempt")
        return self.every_attempt(name).join(done, ["run_id", "attempt"], "left_semi").drop("attempt")

    def every_attempt(self, name: str) -> DataFrame:
        """Rows of all attempts, running and failed ones included."""
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        return rows.withColumns({c: F.col(c).cast("long") for c in ("run_id", "attempt")})

    def own_rows(self, name: str, run_id: int) -> DataFrame:
        """What the run's newest attempt wrote so far."""
        own = (F.col("run_id") == run_id) & (F.col("attempt") == self._state(run_id)["attempt"])
        return self.every_attempt(name).where(own).drop("attempt")

    def start(
        self, run_id: int | None = None, *, git_sha: str, git_dirty: bool, protocol_id: int,
        feature_schema: str, kind: str, model_family: str, hyperparams: Mapping[str, object], seed: int = 0,
    ) -> int:
        """Open a new run, or the next attempt of a failed one; the id is handed out where none is given."""
        require_compatible(feature_schema, kind)
        state, attempt = None, 1
        if run_id is None:
            run_id = (self._statuses().agg(F.max("run_id")).first()[0] or 0) + 1
            while not self._claim(run_id, attempt):
                run_id += 1
        else:
            state = self._state(run_id)
            if state is not None:
                if state["status"] != "failed":
                    raise PermissionError(f"run {run_id} is {state['status']}; its id cannot be used again")
                attempt = state["attempt"] + 1
            if not self._claim(run_id, attempt):
                raise PermissionError(f"attempt {attempt} of run {run_id} belongs to another caller")
        self._status(
            run_id, attempt, "running", 0 if state is None else state["seq"] + 1, git_sha=git_sha,
            git_dirty=git_dirty, protocol_id=protocol_id, feature_schema=feature_schema,
            model_family=model_family, hyperparams=json.dumps(dict(hyperparams), sort_keys=True), seed=seed,
        )
        return run_id

    def _require_open(self, run_id: int) -> None:
        state = self._state(run_id)
        if state is not None and state["status"] == "completed":
            raise PermissionError("completed run inputs are immutable")

    def _running(self, run_id: int):
        """The status row of a running attempt; any other run takes no more rows."""
        self._require_open(run_id)
        state = self._state(run_id)
        if state is None or state["status"] != "running":
            raise PermissionError(f"run {run_id} is not running")
        return state

    def _put(self, name: str, run_id: int, rows: DataFrame) -> None:
        attempt = self._running(run_id)["attempt"]
        plain = rows.drop("run_id", "attempt")
        folder = f"{self.root}/{name}/run_id={run_id}/attempt={attempt}"
        plain.write.mode("overwrite").option("compression", "zstd").parquet(folder)  # kept for good, half of it digests

    def append_inputs(self, run_id: int, payloads: DataFrame) -> None:
        self._put("feature_rows", run_id, payloads)
        self._put("manifests", run_id, manifest(self.own_rows("feature_rows", run_id), ("run_id",)))

    def append_predictions(self, run_id: int, predictions: DataFrame) -> None:
        self._running(run_id)
        rows = stage(prediction_rows(predictions), "predictions")  # checked before anything reaches the ledger
        if not prediction_problems(rows).isEmpty():
            raise ValueError("a stored probability is outside [0, 1]")
        self._put("predictions", run_id, rows)
        release(rows)

    def append_params(self, run_id: int, params: DataFrame) -> None:
        self._put("models", run_id, params)

    def complete(self, run_id: int, metrics_row: Mapping[str, object]) -> None:
        """Make all that the attempt wrote visible at once."""
        state = self._running(run_id)
        text = json.dumps(dict(metrics_row), sort_keys=True)
        self._status(run_id, state["attempt"], "completed", state["seq"] + 1, metrics=text)

    def fail(self, run_id: int, message: str) -> None:
        state = self._running(run_id)
        self._status(run_id, state["attempt"], "failed", state["seq"] + 1, error_message=message)


def run_experiment(
    ledger: Ledger,
    run_id: int | None,
    family_name: str,
    family,
    matches: DataFrame,
    plan: DataFrame,
    payloads: DataFrame,
    *,
    protocol_id: int,
    feature_schema: str,
    git_sha: str,
    git_dirty: bool,
    seed: int = 0,
) -> DataFrame:
    """Store inputs, fit and predict every fold, store predictions and metrics.

    A failure leaves a failed run behind, none of whose rows are visible, and is raised again; the same id
    may then be run as the next attempt. Without an id the ledger hands one out.
    """
    from dyadflow.operators import stats

    run_id = ledger.start(
        run_id, git_sha=git_sha, git_dirty=git_dirty, protocol_id=protocol_id,
        feature_schema=feature_schema, kind=family.representation_kind, model_family=family_name,
        hyperparams=family.hyperparams, seed=seed,
    )
    try:
        ledger.append_inputs(run_id, payloads)
        result = family.run(matches, plan)
        named = result.predictions.drop("result_a").join(
            matches.select("match_id", "athlete_a_id", "athlete_b_id"), "match_id"
        )
        ledger.append_predictions(run_id, named)
        ledger.append_params(run_id, result.params)
        stored = ledger.own_rows("predictions", run_id)
        scored = stored.join(
            matches.select(
                "match_id", F.col("athlete_a_id").alias("athlete_id"),
                (F.col("result_a") == "win").alias("a_won"),
            ),
            ["match_id", "athlete_id"],
        ).withColumnRenamed("p_win", "p_a")
        summary = stats.metrics(scored)
        ledger.complete(run_id, summary.first().asDict())
        return summary
    except Exception as error:
        ledger.fail(run_id, str(error))
        raise


def evaluate_lockbox_gate(protocol_kind: str, git_dirty: bool) -> None:
    """A lockbox may only be consulted from a clean tree, and only a lockbox."""
    if git_dirty:
        raise RuntimeError("refusing to evaluate a lockbox from a dirty working tree")
    if not protocol_kind.startswith("lockbox"):
        raise ValueError(f"protocol is {protocol_kind!r}, not a lockbox")
