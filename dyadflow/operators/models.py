"""Model families behind one interface, fitted fresh for every fold."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.functions import vocab
from dyadflow.operators import features, ratings
from dyadflow.session import ship_package
from dyadflow.staging import stage

NUMERIC = [
    "prior_rating_a", "prior_rating_b", "head_to_head_diff", "recent_form_a", "recent_form_b",
    "win_rate_a", "win_rate_b", "days_since_last_match_a", "days_since_last_match_b",
]
CATEGORICAL = ["arm", "weight_class"]
EVIDENCE = ["evidence_count", "recent_injury_flag", "technique_advantage_flag"]


@dataclass(frozen=True)
class FoldRun:
    """What a family returns: ``p_a`` per (fold_index, match_id) and its fitted parameters."""

    predictions: DataFrame
    params: DataFrame


@dataclass(frozen=True)
class ModelFamily:
    """``run(matches, plan)`` fits and predicts every fold of a rolling-origin plan."""

    representation_kind: str
    run: Callable[[DataFrame, DataFrame], FoldRun]
    hyperparams: Mapping[str, object] = field(default_factory=dict)


def _tests(matches: DataFrame, plan: DataFrame) -> DataFrame:
    folds = plan.where("fold_index IS NOT NULL").select("event_id", "fold_index")
    return matches.join(folds, "event_id")


def _eligible(matches: DataFrame, plan: DataFrame) -> DataFrame:
    return matches.join(plan.select("event_id"), "event_id", "left_semi")


def _rating_run(eligible: DataFrame, plan: DataFrame, predicted: DataFrame, params: DataFrame, value: str) -> FoldRun:
    """Predictions of the tested matches and, per fold, the ratings its predictions start from."""
    tests = _tests(eligible, plan).select(
        F.col("fold_index").cast("long").alias("fold_index"), "match_id", "result_a"
    )
    return FoldRun(
        tests.join(predicted.select("match_id", "p_a"), "match_id"),
        params.select("fold_index", F.col("athlete_id").cast("string").alias("name"), F.col(value).alias("value")),
    )


def elo_family(k_factor: float = vocab.ELO_K) -> ModelFamily:
    def run(matches: DataFrame, plan: DataFrame) -> FoldRun:
        eligible = _eligible(matches, plan)
        states = ratings.elo_states(eligible, k_factor)
        predicted = ratings.elo_cutoff_predictions(eligible, states=states)
        return _rating_run(eligible, plan, predicted, ratings.fold_ratings(eligible, states, plan), "rating")

    return ModelFamily("rating", run, {"k_factor": k_factor})


def glicko_family() -> ModelFamily:
    def run(matches: DataFrame, plan: DataFrame) -> FoldRun:
        eligible = _eligible(matches, plan)
        states = ratings.glicko_states(eligible)
        predicted = ratings.glicko_cutoff_predictions(eligible, states)
        return _rating_run(eligible, plan, predicted, ratings.fold_ratings(eligible, states, plan, ["mu"]), "mu")

    return ModelFamily("rating", run)


def _folds(plan: DataFrame) -> list[tuple[int, int]]:
    """(fold, position of its tested event), one row per fold on the driver."""
    rows = plan.where("fold_index IS NOT NULL").select("fold_index", "position").orderBy("fold_index").collect()
    if not rows:
        raise ValueError("the protocol has no fold to fit")
    return [(int(r["fold_index"]), int(r["position"])) for r in rows]


def _trained_by(folds: Sequence[tuple[int, int]]) -> Column:
    """The folds that train on a row at ``position``: those whose tested event comes later."""
    every = F.array(*[
        F.struct(F.lit(fold).cast("long").alias("fold_index"), F.lit(at).alias("at")) for fold, at in folds
    ])
    return F.transform(F.filter(every, lambda f: f["at"] > F.col("position")), lambda f: f["fold_index"])


def bradley_terry_family(alpha: float = vocab.BT_ALPHA) -> ModelFamily:
    def run(matches: DataFrame, plan: DataFrame) -> FoldRun:
        placed = stage(
            matches.join(plan.select("event_id", "position", "fold_index"), "event_id"), "bt-matches"
        )

        # folds in the order of their positions: what one trains on, all later ones do too
        ordered = sorted(_folds(plan), key=lambda fold: fold[1])
        ends = F.array(*[F.lit(at) for _, at in ordered])
        first = F.size(F.filter(ends, lambda at: at <= F.col("position")))
        games = (
            ratings.pair_results(placed.withColumn("first", first), "first")
            .where(F.col("first") < len(ordered))
        )
        numbers = F.array(*[F.lit(fold).cast("long") for fold, _ in ordered])
        strengths = ratings.fit_strengths(games, len(ordered), alpha, tolerance=1e-9).select(
            F.get(numbers, F.col("set")).alias("fold_index"), "athlete_id", "strength"
        )
        test = placed.where("fold_index IS NOT NULL").withColumn(
            "fold_index", F.col("fold_index").cast("long")
        )
        scored = ratings.bradley_terry_predictions(test, strengths, ["fold_index"])
        return FoldRun(
            scored.select("fold_index", "match_id", "result_a", "p_a"),
            strengths.select(
                "fold_index", F.col("athlete_id").cast("string").alias("name"),
                F.col("strength").alias("value"),
            ),
        )

    return ModelFamily("rating", run, {"l2_regularization": alpha})


DEGENERATE = "degenerate_single_class_fold"
MAX_STEPS = 200  # of the climb; beyond it fitting fails rather than returning what it has


def _slopes(rows: DataFrame, numeric: Sequence[str], levels: Sequence[tuple[str, str]], at: dict) -> dict:
    """Loss, gradient and curvature of every fold's weights in one pass over its training rows.

    ``at`` maps a fold to (position, weights). Tasks add up their own rows; what reaches the driver is
    a square of the number of coefficients for each fold, whatever the rows. A batch is put in the order
    of its positions once: what a fold trains on is then the first of its rows, read in place.
    """
    import numpy as np

    size = len(numeric) + len(levels) + 1

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        sums = {fold: np.zeros(1 + size + size * size) for fold in at}
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            place = column("position").to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            place = place[order]
            label = column("label").to_numpy(zero_copy_only=False)[order]
            x = np.empty((size, batch.num_rows))
            for i, name in enumerate(numeric):
                x[i] = column(name).to_numpy(zero_copy_only=False)[order]
            for i, (name, level) in enumerate(levels, len(numeric)):
                held = pc.fill_null(pc.equal(column(name), pa.scalar(level, pa.string())), False)
                x[i] = held.to_numpy(zero_copy_only=False)[order]
            x[-1] = 1.0
            sign = 1.0 - 2.0 * label
            for fold, (until, weights) in at.items():
                n = int(np.searchsorted(place, until))
                if n == 0:
                    continue
                own = x[:, :n]
                z = weights @ own
                p = 0.5 * (1.0 + np.tanh(0.5 * z))
                curved = (own * (p * (1.0 - p))) @ own.T
                sums[fold] += np.concatenate(
                    [[np.logaddexp(0.0, sign[:n] * z).sum()], own @ (p - label[:n]), curved.ravel()]
                )
        yield pa.RecordBatch.from_pydict({
            "fold": pa.array(list(sums), pa.int64()),
            "sums": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())),
        })

    parts = rows.mapInArrow(run, "fold bigint, sums array<double>")
    cells = parts.select("fold", F.posexplode("sums").alias("cell", "value"))
    total = cells.groupBy("fold", "cell").agg(F.sum("value").alias("value"))
    out = {fold: np.zeros(1 + size + size * size) for fold in at}
    for row in total.collect():
        out[row["fold"]][row["cell"]] = row["value"]
    return {
        fold: (v[0], v[1 : 1 + size], v[1 + size :].reshape(size, size)) for fold, v in out.items()
    }


def _climb(rows: DataFrame, numeric: Sequence[str], levels: Sequence[tuple[str, str]], until: dict[int, int]) -> dict:
    """Newton's method on sum(loss) + |weights|^2 / 2 for all folds together, the intercept free.

    Every pass over the rows serves all folds still climbing; a step that does not descend is halved.
    """
    import numpy as np

    size = len(numeric) + len(levels) + 1
    ridge = np.ones(size)
    ridge[-1] = 0.0
    best: dict[int, tuple] = {}  # fold: (objective, weights, step)
    trial = {fold: np.zeros(size) for fold in until}
    done: dict[int, np.ndarray] = {}
    for _ in range(MAX_STEPS):
        found = _slopes(rows, numeric, levels, {f: (until[f], w) for f, w in trial.items()})
        for fold, (loss, gradient, curved) in found.items():
            weights = trial[fold]
            objective = loss + 0.5 * (ridge * weights**2).sum()
            if not np.isfinite(objective) and fold not in best:
                raise ValueError("a training feature is null or not finite")
            if fold in best and not objective <= best[fold][0] + 1e-9 * (1.0 + abs(best[fold][0])):
                low, start, step = best[fold]
                best[fold] = (low, start, step / 2.0)
                trial[fold] = start + step / 2.0
                continue
            slope, bend = gradient + ridge * weights, curved + np.diag(ridge)
            scale = 1.0 / np.sqrt(np.maximum(np.diag(bend), 1e-300))
            step = -scale * np.linalg.solve(bend * scale[:, None] * scale, slope * scale)
            best[fold] = (objective, weights, step)
            trial[fold] = weights + step
            if -slope @ step < 1e-9:  # the last step squares what is left
                done[fold] = trial.pop(fold)
        if not trial:
            return done
    raise RuntimeError(f"no convergence after {MAX_STEPS} steps for folds {sorted(trial)}")


def _weighed(rows: DataFrame, params: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``rows`` with their fold's weights as the map ``_w`` and the linear score ``_z``.

    Names a fold has no weight for count as zero: unseen categories, and all of a degenerate fold.
    """
    plain = ["intercept", *numeric]
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    # a row per fold, whose size Spark cannot know beforehand: unasked it would move all rows to it
    per_fold = F.broadcast(params.groupBy("fold_index").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_w"),
        *[F.coalesce(of(name), F.lit(0.0)).alias(f"_w{i}") for i, name in enumerate(plain)],
    ))
    score = F.col("_w0")
    for i, name in enumerate(numeric, 1):
        score = score + F.col(name) * F.col(f"_w{i}")
    for name in categorical:
        level = F.concat(F.lit(f"{name}="), F.coalesce(F.col(name), F.lit("")))
        score = score + F.coalesce(F.try_element_at("_w", level), F.lit(0.0))
    given = rows.columns
    return rows.join(per_fold, "fold_index").select(*given, "_w", score.alias("_z"))


def fit_logistic_folds(
    train: DataFrame,
    test: DataFrame,
    folds: Sequence[tuple[int, int]],
    numeric: Sequence[str] = tuple(NUMERIC),
    categorical: Sequence[str] = tuple(CATEGORICAL),
) -> FoldRun:
    """Penalised logistic regression of every fold, in one climb.

    ``train`` rows carry ``position``; a fold trains on those before its own. ``test`` rows carry
    ``fold_index``. A fold's vocabulary is what its training rows hold: a category they never show
    has no weight and counts as zero. Where they hold a single outcome, no boundary can be placed
    and the prediction is 0.5 throughout. The number of categories must suit a square matrix.
    """
    spark = train.sparkSession
    ship_package(spark)
    seen: dict[tuple[str, str], int] = {}
    for name in categorical:
        for row in train.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("position").alias("at")).collect():
            seen[(name, row[name])] = row["at"]
    levels = sorted(seen)
    wins = train.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("won")).collect()
    until = {}
    for fold, at in folds:
        n = sum(r["n"] for r in wins if r["position"] < at)
        won = sum(r["won"] for r in wins if r["position"] < at)
        if 0 < won < n:
            until[fold] = at
    fitted = _climb(train.select(*numeric, *categorical, "label", "position"), numeric, levels, until) if until else {}
    values = []
    for fold, at in folds:
        if fold not in fitted:
            values.append((fold, DEGENERATE, 1.0))
            continue
        named = [*numeric, *[f"{c}={v}" for c, v in levels], "intercept"]
        unseen = {f"{c}={v}" for (c, v), first in seen.items() if first >= at}
        values += [
            (fold, n, float(w)) for n, w in zip(named, fitted[fold], strict=True) if n not in unseen
        ]
    params = spark.createDataFrame(values, "fold_index long, name string, value double")
    scored = _weighed(test.withColumn("fold_index", F.col("fold_index").cast("long")), params, numeric, categorical)
    p_a = (1.0 / (1.0 + F.exp(-F.col("_z")))).alias("p_a")
    return FoldRun(scored.select("fold_index", "match_id", "result_a", p_a), params)


def fit_logistic(
    train: DataFrame,
    test: DataFrame,
    numeric: Sequence[str] = tuple(NUMERIC),
    categorical: Sequence[str] = tuple(CATEGORICAL),
) -> FoldRun:
    """``fit_logistic_folds`` with all of ``train`` and ``test`` as one fold."""
    run = fit_logistic_folds(
        train.withColumn("position", F.lit(0)), test.withColumn("fold_index", F.lit(0)), [(0, 1)],
        numeric, categorical,
    )
    return FoldRun(run.predictions.drop("fold_index"), run.params.drop("fold_index"))


def logistic_gradient(
    train: DataFrame,
    params: DataFrame,
    folds: Sequence[tuple[int, int]],
    numeric: Sequence[str] = tuple(NUMERIC),
    categorical: Sequence[str] = tuple(CATEGORICAL),
) -> DataFrame:
    """(fold_index, name, gradient) of the penalised loss at ``params``: all zero at the optimum.

    Relative to the total magnitude of the feature's values, so that one rounding suits all features.
    """
    rows = train.withColumn("fold_index", F.explode(_trained_by(folds)))
    miss = 1.0 / (1.0 + F.exp(-F.col("_z"))) - F.col("label")
    weighed = _weighed(rows, params, numeric, categorical).withColumn("_miss", miss)
    # added up by what the rows share, so that a row is read once and not once for every name
    met = weighed.groupBy("fold_index", *categorical).agg(
        F.sum("_miss").alias("_miss"), F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.sum(F.col("_miss") * F.col(n)).alias(f"_slope{i}") for i, n in enumerate(numeric)],
        *[F.sum(F.abs(n)).alias(f"_size{i}") for i, n in enumerate(numeric)],
    )
    one = lambda name, slope, size: F.struct(
        name.alias("name"), F.col(slope).alias("slope"), F.col(size).cast("double").alias("size")
    )
    inputs = [
        *[one(F.lit(n), f"_slope{i}", f"_size{i}") for i, n in enumerate(numeric)],
        *[one(F.concat(F.lit(f"{n}="), F.col(n)), "_miss", "_n") for n in categorical],
        one(F.lit("intercept"), "_miss", "_n"),
    ]
    sums = met.select("fold_index", F.explode(F.array(*inputs)).alias("i")).groupBy(
        "fold_index", F.col("i.name").alias("name")
    ).agg(F.sum("i.slope").alias("slope"), F.sum("i.size").alias("size"))
    penalty = F.when(F.col("name") == "intercept", 0.0).otherwise(F.col("value"))
    gradient = (F.col("slope") + penalty) / F.greatest("size", F.lit(1.0))
    return sums.join(params, ["fold_index", "name"]).select("fold_index", "name", gradient.alias("gradient"))


def tabular_inputs(
    matches: DataFrame, evidence: DataFrame | None = None, default_ratings: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Training rows (as of each match) and test rows (as of each event) for the tabular models."""
    history = stage(ratings.elo_history(matches), "ratings")
    train = features.history_features(matches, history, default_ratings)
    cutoff = ratings.cutoff_ratings(history).select(
        "match_id",
        F.col("rating_a").alias("prior_rating_a"),
        F.col("rating_b").alias("prior_rating_b"),
    )
    test = features.with_default_ratings(
        features.cutoff_features(matches).join(cutoff, "match_id"), default_ratings
    )
    if evidence is not None:
        extra = evidence.select("match_id", *[F.col(c).cast("double").alias(c) for c in EVIDENCE])
        train, test = train.join(extra, "match_id"), test.join(extra, "match_id")
    return train, test


def placed_inputs(train: DataFrame, test: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tabular_inputs`` along a plan, written once: training rows by position, test rows by fold."""
    place = plan.select("event_id", "position", "fold_index")
    return (
        stage(train.join(place, "event_id"), "train-rows"),
        stage(test.join(place, "event_id").where("fold_index IS NOT NULL"), "test-rows"),
    )


def logistic_family(
    evidence: DataFrame | None = None,
    default_ratings: DataFrame | None = None,
    placed: tuple[DataFrame, DataFrame] | None = None,
) -> ModelFamily:
    """Logistic regression on history features, with the evidence columns when given.

    ``placed`` are the inputs of the same matches and plan, for a caller that goes on with them.
    """
    numeric = NUMERIC if evidence is None else [*NUMERIC, *EVIDENCE]

    def run(matches: DataFrame, plan: DataFrame) -> FoldRun:
        train, test = placed or placed_inputs(
            *tabular_inputs(_eligible(matches, plan), evidence, default_ratings), plan
        )
        return fit_logistic_folds(train, test, _folds(plan), numeric)

    return ModelFamily("tabular", run)


FAMILIES: dict[str, Callable[..., ModelFamily]] = {
    "elo": elo_family,
    "glicko2": glicko_family,
    "bradley_terry": bradley_terry_family,
    "logreg": logistic_family,
    "evidence_v1": logistic_family,
}


def register_family(name: str, factory: Callable[..., ModelFamily]) -> None:
    """Add a family of one's own."""
    FAMILIES[name] = factory


def resolve_family(name: str, **options) -> ModelFamily:
    if name not in FAMILIES:
        raise ValueError(f"unknown model family {name!r}")
    if name == "evidence_v1" and options.get("evidence") is None:
        raise ValueError("evidence_v1 needs the encoded evidence")
    return FAMILIES[name](**options)
