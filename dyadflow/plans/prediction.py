"""Registered queries of the prediction track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions import scoring, vocab
from dyadflow.operators import dyads as dy
from dyadflow.operators import evidence, features, folds, ledger, models, ratings, stats
from dyadflow.operators.running import running_before
from dyadflow.plans import fixtures as fx
from dyadflow.plans.fixtures import DYADS, SIDES, with_ctes
from dyadflow.staging import stage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def _completed(spark: SparkSession, sf: str) -> DataFrame:
    """Completed matches, written once: the operators measure and then read them."""
    return stage(fx.completed(spark, sf), "matches")


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# ---------------------------------------------------------------- canonical table and long form


@query(
    "dyads",
    with_ctes(
        """SELECT match_id, event_id, strftime(held_on, '%Y-%m-%d') AS held_on,
  strftime(scheduled_at, '%Y-%m-%d') AS scheduled_at, arm, weight_class, athlete_a_id,
  athlete_b_id, result_a FROM matches""",
        DYADS,
    ),
)
def dyads(spark, sf):
    base = stage(fx.dyads(spark, sf), "dyads")
    _, result_b = dy.derive_results(F.col("score_a"), F.col("score_b"), F.col("status"))
    one = lambda a, r: F.struct(F.col(a).alias("athlete_id"), r.alias("result"))
    competitors = base.select(
        "match_id",
        F.explode(
            F.array(one("athlete_b_id", result_b), one("athlete_a_id", F.col("result_a")))
        ).alias("c"),
    ).select("match_id", "c.*")
    matches = base.drop("athlete_a_id", "athlete_b_id", "score_a", "score_b", "result_a")
    return dy.completed_matches(matches, competitors).select(
        "match_id", "event_id", _day("held_on"), _day("scheduled_at"), "arm", "weight_class",
        "athlete_a_id", "athlete_b_id", "result_a",
    )


@query(
    "athlete_long",
    with_ctes("SELECT match_id, side, athlete_id, opponent_id, won FROM sides", DYADS, SIDES),
)
def athlete_long(spark, sf):
    return dy.sides(fx.completed(spark, sf)).select(
        "match_id", "side", "athlete_id", "opponent_id", "won"
    )


@query(
    "athlete_records",
    with_ctes(
        """SELECT athlete_id, count(*) AS matches, CAST(sum(won) AS BIGINT) AS wins,
  count(DISTINCT opponent_id) AS opponents FROM sides GROUP BY 1""",
        DYADS,
        SIDES,
    ),
)
def athlete_records(spark, sf):
    return dy.sides(fx.completed(spark, sf)).groupBy("athlete_id").agg(
        F.count(F.lit(1)).alias("matches"),
        F.sum("won").cast("long").alias("wins"),
        F.count_distinct("opponent_id").alias("opponents"),
    )


# ---------------------------------------------------------------- point-in-time features

HISTORY = """
history AS (
  SELECT *,
    coalesce(avg(won) OVER w, 0.5) AS win_rate,
    coalesce(avg(won) OVER (PARTITION BY athlete_id ORDER BY scheduled_at, match_id
      ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.5) AS recent_form,
    coalesce(epoch_us(scheduled_at) - epoch_us(lag(scheduled_at) OVER (
      PARTITION BY athlete_id ORDER BY scheduled_at, match_id)), -86400000000.0)
      / 86400000000.0 AS days_since_last_match,
    count(*) OVER w AS prior_matches
  FROM sides WINDOW w AS (PARTITION BY athlete_id ORDER BY scheduled_at, match_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""".strip()

HEAD_TO_HEAD = """
h2h AS (
  SELECT match_id, coalesce(sum(CASE WHEN result_a = 'win' THEN 1.0 ELSE -1.0 END) OVER (
    PARTITION BY athlete_a_id, athlete_b_id ORDER BY scheduled_at, match_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS head_to_head_diff
  FROM matches)
""".strip()

# one step per event; the state is one row per athlete
ELO = """
elo_games AS MATERIALIZED (
  SELECT match_id, event_id, athlete_a_id AS a, athlete_b_id AS b,
    CASE WHEN result_a = 'win' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS won,
    dense_rank() OVER (ORDER BY held_on, event_id) AS step FROM matches),
elo_sides AS MATERIALIZED (
  SELECT step, a AS athlete_id, b AS opponent_id, won FROM elo_games
  UNION ALL SELECT step, b, a, 1.0 - won FROM elo_games),
elo_state AS (
  SELECT 0::BIGINT AS step, athlete_id, 1500.0::DOUBLE AS prior, 1500.0::DOUBLE AS rating
  FROM (SELECT DISTINCT athlete_id FROM elo_sides)
  UNION ALL
  SELECT s.step + 1, s.athlete_id, s.rating, s.rating + coalesce(g.gain, 0.0)
  FROM elo_state s LEFT JOIN (
    SELECT e.athlete_id,
      sum(24.0 * (e.won - 1.0 / (1.0 + pow(10.0, (o.rating - m.rating) / 400.0)))) AS gain
    FROM elo_sides e JOIN elo_state m ON m.athlete_id = e.athlete_id AND e.step = m.step + 1
    JOIN elo_state o ON o.athlete_id = e.opponent_id GROUP BY 1) g USING (athlete_id)
  WHERE s.step < (SELECT max(step) FROM elo_games)),
elo AS (
  SELECT g.match_id, g.event_id, g.a, g.b, x.prior AS prior_a, y.prior AS prior_b,
    x.rating AS post_a, y.rating AS post_b
  FROM elo_games g JOIN elo_state x ON x.step = g.step AND x.athlete_id = g.a
  JOIN elo_state y ON y.step = g.step AND y.athlete_id = g.b)
""".strip()


def with_recursive(sql: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + sql


@query(
    "win_rate",
    with_ctes(
        "SELECT match_id, side, athlete_id, round(win_rate, 6) AS win_rate, prior_matches FROM history",
        DYADS, SIDES, HISTORY,
    ),
)
def win_rate(spark, sf):
    return features.athlete_history(_completed(spark, sf)).select(
        "match_id", "side", "athlete_id", _r("win_rate"),
        F.col("prior_matches").cast("long").alias("prior_matches"),
    )


@query(
    "win_rate_ranged",
    with_ctes(
        "SELECT match_id, side, athlete_id, round(win_rate, 6) AS win_rate, prior_matches FROM history",
        DYADS, SIDES, HISTORY,
    ),
)
def win_rate_ranged(spark, sf):
    # so few rows a task that athletes span several ranges, in about 64 ranges at any size
    rows = _completed(spark, sf)
    return features.athlete_history(rows, max_rows_per_task=max(1, rows.count() // 16)).select(
        "match_id", "side", "athlete_id", _r("win_rate"),
        F.col("prior_matches").cast("long").alias("prior_matches"),
    )


@query(
    "recent_form",
    with_ctes(
        "SELECT match_id, side, athlete_id, round(recent_form, 6) AS recent_form FROM history",
        DYADS, SIDES, HISTORY,
    ),
)
def recent_form(spark, sf):
    return features.athlete_history(_completed(spark, sf)).select(
        "match_id", "side", "athlete_id", _r("recent_form")
    )


@query(
    "days_since",
    with_ctes(
        """SELECT match_id, side, athlete_id, round(days_since_last_match, 6) AS days_since_last_match
  FROM history""",
        DYADS, SIDES, HISTORY,
    ),
)
def days_since(spark, sf):
    return features.athlete_history(_completed(spark, sf)).select(
        "match_id", "side", "athlete_id", _r("days_since_last_match")
    )


@query(
    "recent_provenance",
    with_ctes(
        """SELECT match_id, side, coalesce(array_to_string(list(match_id) OVER (
    PARTITION BY athlete_id ORDER BY scheduled_at, match_id
    ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ','), '') AS recent_match_ids FROM sides""",
        DYADS, SIDES,
    ),
)
def recent_provenance(spark, sf):
    return features.athlete_history(_completed(spark, sf)).select(
        "match_id", "side", F.array_join("recent_match_ids", ",").alias("recent_match_ids")
    )


@query(
    "head_to_head",
    with_ctes("SELECT match_id, head_to_head_diff FROM h2h", DYADS, HEAD_TO_HEAD),
)
def head_to_head(spark, sf):
    return features.head_to_head(_completed(spark, sf)).select(
        "match_id", F.col("head_to_head_diff").cast("double").alias("head_to_head_diff")
    )


_HISTORY_COLUMNS = [
    "prior_rating_a", "prior_rating_b", "head_to_head_diff", "recent_form_a", "recent_form_b",
    "win_rate_a", "win_rate_b", "days_since_last_match_a", "days_since_last_match_b", "label",
]


@query(
    "history_features",
    with_recursive(
        """SELECT m.match_id, m.arm, m.weight_class, round(e.prior_a, 6) AS prior_rating_a,
  round(e.prior_b, 6) AS prior_rating_b, h.head_to_head_diff,
  round(a.recent_form, 6) AS recent_form_a, round(b.recent_form, 6) AS recent_form_b,
  round(a.win_rate, 6) AS win_rate_a, round(b.win_rate, 6) AS win_rate_b,
  round(a.days_since_last_match, 6) AS days_since_last_match_a,
  round(b.days_since_last_match, 6) AS days_since_last_match_b,
  CASE WHEN m.result_a = 'win' THEN 1.0 ELSE 0.0 END::DOUBLE AS label
FROM matches m JOIN elo e USING (match_id) JOIN h2h h USING (match_id)
JOIN history a ON a.match_id = m.match_id AND a.side = 'a'
JOIN history b ON b.match_id = m.match_id AND b.side = 'b'""",
        DYADS, SIDES, HISTORY, HEAD_TO_HEAD, ELO,
    ),
)
def history_features(spark, sf):
    matches = _completed(spark, sf)
    rows = features.history_features(matches, ratings.elo_history(matches))
    return rows.select("match_id", "arm", "weight_class", *[_r(c) for c in _HISTORY_COLUMNS])


ASOF = """
at_event AS (
  SELECT *,
    coalesce(avg(won) OVER w, 0.5) AS win_rate,
    count(*) OVER w AS prior_matches,
    coalesce(epoch_us(scheduled_at) - epoch_us(max(scheduled_at) OVER w), -86400000000.0)
      / 86400000000.0 AS days_since_last_match,
    list(won ORDER BY scheduled_at, match_id) OVER w AS earlier
  FROM sides WINDOW w AS (PARTITION BY athlete_id ORDER BY event_id
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
at_event_h2h AS (
  SELECT match_id, coalesce(sum(CASE WHEN result_a = 'win' THEN 1.0 ELSE -1.0 END) OVER (
    PARTITION BY athlete_a_id, athlete_b_id ORDER BY event_id
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS head_to_head_diff
  FROM matches),
at_event_form AS (
  SELECT *, coalesce(list_avg(earlier[-5:]), 0.5) AS recent_form FROM at_event)
""".strip()


@query(
    "asof_features",
    with_ctes(
        """SELECT m.match_id, h.head_to_head_diff, a.prior_matches AS prior_matches_a,
  b.prior_matches AS prior_matches_b,
  round(a.recent_form, 6) AS recent_form_a, round(b.recent_form, 6) AS recent_form_b,
  round(a.win_rate, 6) AS win_rate_a, round(b.win_rate, 6) AS win_rate_b,
  round(a.days_since_last_match, 6) AS days_since_last_match_a,
  round(b.days_since_last_match, 6) AS days_since_last_match_b
FROM matches m JOIN at_event_h2h h USING (match_id)
JOIN at_event_form a ON a.match_id = m.match_id AND a.side = 'a'
JOIN at_event_form b ON b.match_id = m.match_id AND b.side = 'b'""",
        DYADS, SIDES, ASOF,
    ),
)
def asof_features(spark, sf):
    rows = features.cutoff_features(_completed(spark, sf))
    doubles = [c for c in _HISTORY_COLUMNS if c not in ("prior_rating_a", "prior_rating_b", "label")]
    return rows.select(
        "match_id", *[_r(c) for c in doubles],
        *[F.col(f"prior_matches_{s}").cast("long").alias(f"prior_matches_{s}") for s in "ab"],
    )


# ---------------------------------------------------------------- ratings


@query(
    "elo_ratings",
    with_recursive(
        """SELECT match_id, round(prior_a, 6) AS prior_rating_a, round(prior_b, 6) AS prior_rating_b,
  round(post_a, 6) AS post_rating_a, round(post_b, 6) AS post_rating_b FROM elo""",
        DYADS, ELO,
    ),
)
def elo_ratings(spark, sf):
    rows = ratings.elo_history(_completed(spark, sf))
    return rows.select(
        "match_id",
        *[_r(f"{w}_rating_{s}") for w in ("prior", "post") for s in "ab"],
    )


@query(
    "elo_final_ratings",
    with_recursive(
        """SELECT athlete_id, round(rating, 6) AS rating FROM elo_state
WHERE step = (SELECT max(step) FROM elo_games)""",
        DYADS, ELO,
    ),
)
def elo_final_ratings(spark, sf):
    return ratings.final_ratings(ratings.elo_states(_completed(spark, sf))).select(
        "athlete_id", _r("rating")
    )


# predictions from the ratings before the event
ELO_CUTOFF = """
predicted AS (
  SELECT m.match_id, m.event_id, e.prior_a AS rating_a, e.prior_b AS rating_b,
    1.0 / (1.0 + pow(10.0, (e.prior_b - e.prior_a) / 400.0)) AS p_a, m.result_a = 'win' AS a_won
  FROM matches m JOIN elo e USING (match_id))
""".strip()

FOLDS = """
event_sizes AS (SELECT event_id, count(*) AS test_count FROM matches GROUP BY 1),
eligible AS (
  SELECT e.event_id, e.held_on, coalesce(test_count, 0) AS test_count,
    row_number() OVER (ORDER BY e.held_on, e.event_id) - 1 AS position
  FROM (SELECT DISTINCT event_id, held_on FROM dyads
        WHERE event_id < (SELECT max(event_id) - 1 FROM dyads)) e
  LEFT JOIN event_sizes USING (event_id)),
folds AS (
  SELECT *, coalesce(sum(test_count) OVER (ORDER BY position
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS train_count,
    row_number() OVER (ORDER BY (position >= 8 AND test_count > 0) DESC, position) - 1 AS fold_index
  FROM eligible),
tested AS (SELECT * FROM folds WHERE position >= 8 AND test_count > 0)
""".strip()
MIN_TRAINING_EVENTS = 8


def _plan(spark, sf, min_training_events=MIN_TRAINING_EVENTS):
    """Rolling-origin plan over all events; the two latest events are a lockbox and excluded."""
    everything = stage(fx.dyads(spark, sf), "dyads")
    matches = everything.where("status = 'completed'").drop("score_a", "score_b", "status")
    events = everything.select("event_id", "held_on").distinct()
    excluded = events.orderBy(F.desc("event_id")).limit(2)
    return matches, events, folds.rolling_origin(events, matches, min_training_events, excluded)


@query(
    "rolling_folds",
    with_ctes(
        """SELECT fold_index, event_id, strftime(held_on, '%Y-%m-%d') AS held_on, position,
  train_count, test_count FROM tested""",
        DYADS, FOLDS,
    ),
)
def rolling_folds(spark, sf):
    _, _, plan = _plan(spark, sf)
    return plan.where("fold_index IS NOT NULL").select(
        F.col("fold_index").cast("long").alias("fold_index"), "event_id", _day("held_on"),
        F.col("position").cast("long").alias("position"),
        F.col("train_count").cast("long").alias("train_count"),
        F.col("test_count").cast("long").alias("test_count"),
    )


MEMBERS = """
members AS (
  SELECT t.fold_index, CASE WHEN e.position < t.position THEN 'train' ELSE 'test' END AS role,
    m.match_id FROM tested t JOIN eligible e ON e.position <= t.position
  JOIN matches m ON m.event_id = e.event_id)
""".strip()


@query(
    "fold_membership",
    with_ctes("SELECT fold_index, role, match_id FROM members", DYADS, FOLDS, MEMBERS),
)
def fold_membership(spark, sf):
    matches, _, plan = _plan(spark, sf)
    return folds.fold_members(plan, matches).select(
        F.col("fold_index").cast("long").alias("fold_index"), "role", "match_id"
    )


@query(
    "lockbox_fold",
    with_ctes(
        """SELECT 0::BIGINT AS fold_index, CASE WHEN event_id >= (SELECT max(event_id) - 1 FROM dyads)
  THEN 'test' ELSE 'train' END AS role, match_id FROM matches""",
        DYADS,
    ),
)
def lockbox_fold(spark, sf):
    everything = stage(fx.dyads(spark, sf), "dyads")
    events = everything.select("event_id", "held_on").distinct()
    chosen = events.orderBy(F.desc("event_id")).limit(2)
    return folds.lockbox(events, everything.where("status = 'completed'"), chosen).select(
        "fold_index", "role", "match_id"
    )


@query(
    "lockbox_events",
    with_ctes(
        "SELECT DISTINCT event_id FROM matches WHERE event_id >= (SELECT max(event_id) - 1 FROM dyads)",
        DYADS,
    ),
)
def lockbox_events(spark, sf):
    everything = stage(fx.dyads(spark, sf), "dyads")
    matches = everything.where("status = 'completed'")
    events = everything.select("event_id", "held_on").distinct()
    members = folds.lockbox(events, matches, events.orderBy(F.desc("event_id")).limit(2))
    return folds.lockbox_events(members, matches)


@query(
    "prospective_growth",
    with_ctes(
        """SELECT match_id, row_number() OVER (ORDER BY event_id, status = 'no_contest' AND event_id = first_id,
    match_id) - 1 AS seq
FROM dyads, (SELECT max(event_id) - 1 AS first_id FROM dyads)
WHERE (event_id = first_id AND status = 'completed') OR event_id = first_id + 1""",
        DYADS,
    ),
)
def prospective_growth(spark, sf):
    everything = stage(fx.dyads(spark, sf), "dyads")
    last = everything.agg(F.max("event_id")).first()[0]
    first = everything.where((F.col("event_id") == last - 1) & (F.col("status") == "completed"))
    empty = first.select("match_id", F.lit(0).cast("long").alias("seq")).where("false")
    members = folds.grow_prospective(empty, first, last - 1)
    grown = folds.grow_prospective(members, everything, last)
    return folds.grow_prospective(grown, everything, last)


@query(
    "elo_fold_predictions",
    with_recursive(
        """SELECT t.fold_index, p.match_id, round(p.rating_a, 6) AS rating_a,
  round(p.rating_b, 6) AS rating_b, round(p.p_a, 6) AS p_a
FROM predicted p JOIN tested t USING (event_id)""",
        DYADS, FOLDS, ELO, ELO_CUTOFF,
    ),
)
def elo_fold_predictions(spark, sf):
    matches, _, plan = _plan(spark, sf)
    predicted = ratings.elo_cutoff_predictions(matches.join(plan.select("event_id"), "event_id", "left_semi"))
    tests = plan.where("fold_index IS NOT NULL").select("event_id", "fold_index")
    return predicted.join(tests, "event_id").select(
        F.col("fold_index").cast("long").alias("fold_index"), "match_id",
        _r("rating_a"), _r("rating_b"), _r("p_a"),
    )


def _sql_metrics(by: str, source: str) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {keys}n, round(k / n, 6) AS accuracy,
  round(((k / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((k / n) * (1 - k / n) / n
    + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS accuracy_ci_lower,
  round(((k / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((k / n) * (1 - k / n) / n
    + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS accuracy_ci_upper,
  round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score
FROM (SELECT {keys}count(*) AS n,
    CAST(count(*) FILTER (WHERE (p_a >= 0.5) = a_won) AS DOUBLE) AS k,
    avg(-ln(least(greatest(CASE WHEN a_won THEN p_a ELSE 1 - p_a END, 1e-15), 1 - 1e-15))) AS log_loss,
    avg(pow(p_a - CASE WHEN a_won THEN 1.0 ELSE 0.0 END, 2)) AS brier_score
  FROM {source}{group})"""


_METRIC_COLUMNS = [
    "accuracy", "accuracy_ci_lower", "accuracy_ci_upper", "log_loss", "brier_score",
]


def _elo_scored(spark, sf):
    matches, _, plan = _plan(spark, sf)
    eligible = matches.join(plan.select("event_id"), "event_id", "left_semi")
    tests = plan.where("fold_index IS NOT NULL").select("event_id", "fold_index")
    return ratings.elo_cutoff_predictions(eligible).join(tests, "event_id").withColumn(
        "a_won", F.col("result_a") == "win"
    )


@query(
    "elo_metrics",
    with_recursive(
        _sql_metrics("fold_index", "(SELECT * FROM predicted JOIN tested USING (event_id))"),
        DYADS, FOLDS, ELO, ELO_CUTOFF,
    ),
)
def elo_metrics(spark, sf):
    return stats.metrics(_elo_scored(spark, sf), ["fold_index"]).select(
        F.col("fold_index").cast("long").alias("fold_index"), "n", *[_r(c) for c in _METRIC_COLUMNS]
    )


@query(
    "cold_start",
    with_recursive(
        _sql_metrics(
            "has_signal",
            "(SELECT *, p_a <> 0.5 AS has_signal FROM predicted JOIN tested USING (event_id))",
        ),
        DYADS, FOLDS, ELO, ELO_CUTOFF,
    ),
)
def cold_start(spark, sf):
    return stats.cold_start(_elo_scored(spark, sf)).select(
        "has_signal", "n", *[_r(c) for c in _METRIC_COLUMNS]
    )


_PERIOD = f"""
phi0 AS (SELECT {vocab.GLICKO_PHI!r}::DOUBLE AS phi),
gee AS (SELECT 1.0 / sqrt(1.0 + 3.0 * phi * phi / (pi() * pi())) AS g FROM phi0),
period AS (
  SELECT athlete_id, count(*) AS games, sum(g * g * 0.25) AS information,
    sum(g * (won - 0.5)) AS surprise FROM sides, gee GROUP BY 1)
""".strip()


@query(
    "glicko_period_sums",
    with_ctes(
        """SELECT athlete_id, games, round(information, 6) AS information, round(surprise, 6) AS surprise
FROM period""",
        DYADS, SIDES, _PERIOD,
    ),
)
def glicko_period_sums(spark, sf):
    return ratings.glicko_period_sums(fx.completed(spark, sf)).select(
        "athlete_id", "games", _r("information"), _r("surprise")
    )


_VOLATILITY = """
input AS (SELECT athlete_id, phi, 0.06::DOUBLE AS sigma, information, surprise,
    1.0 / information AS v, surprise / information AS delta, ln(0.06 * 0.06) AS a FROM period, phi0),
starts AS (
  SELECT *, CASE WHEN delta * delta > phi * phi + v THEN ln(delta * delta - phi * phi - v)
    ELSE a - 0.5 * (SELECT min(k) FROM range(1, 200) t(k) WHERE
      exp(a - 0.5 * k) * (delta * delta - phi * phi - v - exp(a - 0.5 * k))
        / (2 * pow(phi * phi + v + exp(a - 0.5 * k), 2)) + 0.5 * k / 0.25 >= 0) END AS low
  FROM input),
ready AS (
  SELECT *, exp(a) * (delta * delta - phi * phi - v - exp(a)) / (2 * pow(phi * phi + v + exp(a), 2)) AS f_up,
    exp(low) * (delta * delta - phi * phi - v - exp(low)) / (2 * pow(phi * phi + v + exp(low), 2))
      - (low - a) / 0.25 AS f_low FROM starts),
solve AS (
  SELECT athlete_id, 0 AS i, a AS up, low, f_up, f_low, a, v, delta, phi, surprise, information FROM ready
  UNION ALL
  SELECT athlete_id, i + 1, CASE WHEN f_mid * f_low < 0 THEN low ELSE up END, mid,
    CASE WHEN f_mid * f_low < 0 THEN f_low ELSE f_up / 2 END, f_mid, a, v, delta, phi, surprise, information
  FROM (SELECT *, exp(mid) * (delta * delta - phi * phi - v - exp(mid))
        / (2 * pow(phi * phi + v + exp(mid), 2)) - (mid - a) / 0.25 AS f_mid
      FROM (SELECT *, up + (up - low) * f_up / (f_low - f_up) AS mid FROM solve
        WHERE abs(low - up) > 1e-6 AND i < 100))),
solved AS (SELECT athlete_id, arg_max(exp(up / 2), i) AS sigma, first(phi) AS phi,
    first(information) AS information, first(surprise) AS surprise FROM solve GROUP BY 1)
""".strip()


@query(
    "glicko_period",
    with_recursive(
        """SELECT athlete_id, round(1.0 / (1.0 / (phi * phi + sigma * sigma) + information) * surprise, 6) AS mu,
  round(1.0 / sqrt(1.0 / (phi * phi + sigma * sigma) + information), 6) AS phi,
  round(sigma, 6) AS sigma FROM solved""",
        DYADS, SIDES, _PERIOD, _VOLATILITY,
    ),
)
def glicko_period(spark, sf):
    return ratings.glicko_period(fx.completed(spark, sf)).select(
        "athlete_id", _r("mu"), _r("phi"), _r("sigma")
    )


@query("glicko_events")
def glicko_events(spark, sf):
    rows = ratings.glicko_history(_completed(spark, sf))
    return rows.select(
        "match_id",
        *[_r(f"{w}_{f}_{s}") for w in ("prior", "post") for f in ("mu", "phi", "sigma") for s in "ab"],
    )


@query("glicko_fold_metrics")
def glicko_fold_metrics(spark, sf):
    matches, _, plan = _plan(spark, sf)
    eligible = matches.join(plan.select("event_id"), "event_id", "left_semi")
    tests = plan.where("fold_index IS NOT NULL").select("event_id", "fold_index")
    scored = ratings.glicko_cutoff_predictions(eligible).join(tests, "event_id").withColumn(
        "a_won", F.col("result_a") == "win"
    )
    return stats.metrics(scored, ["fold_index"]).select(
        F.col("fold_index").cast("long").alias("fold_index"), "n", *[_r(c) for c in _METRIC_COLUMNS]
    )


# the same penalised likelihood, climbed by the same curvature-scaled steps on a list of strengths
_BRADLEY_TERRY = """
results AS MATERIALIZED (SELECT athlete_id, opponent_id, count(*) AS games, sum(won) AS wins
  FROM sides GROUP BY 1, 2),
climb AS (
  SELECT 0 AS i, athlete_id, 0.0::DOUBLE AS theta FROM (SELECT DISTINCT athlete_id FROM results)
  UNION ALL
  SELECT i, athlete_id, raw - avg(raw) OVER () FROM (
    SELECT s.i + 1 AS i, s.athlete_id,
      any_value(s.theta) + (sum(r.wins - r.games / (1.0 + exp(-(s.theta - o.theta))))
        - 2.0 * any_value(s.theta)) / (2.0 + sum(r.games) / 2.0) AS raw
    FROM climb s JOIN results r ON r.athlete_id = s.athlete_id
    JOIN climb o ON o.athlete_id = r.opponent_id
    WHERE s.i < 60 GROUP BY s.i, s.athlete_id))
""".strip()


@query(
    "bradley_terry",
    with_recursive(
        "SELECT athlete_id, round(theta, 5) AS strength FROM climb WHERE i = 60",
        DYADS, SIDES, _BRADLEY_TERRY,
    ),
)
def bradley_terry(spark, sf):
    return ratings.bradley_terry(fx.completed(spark, sf), tolerance=1e-8).select(
        "athlete_id", _r("strength", 5)
    )


# ---------------------------------------------------------------- tabular models


def _claims(spark, sf):
    from dyadflow.plans import evidence as ev

    return ev.annotated(spark, sf), ev.subjects(spark, sf)


@query("logreg_history")
def logreg_history(spark, sf):
    matches, _, plan = _plan(spark, sf)
    run = models.logistic_family().run(matches, plan)
    return run.predictions.select("fold_index", "match_id", _r("p_a", 4))


@query("logreg_evidence")
def logreg_evidence(spark, sf):
    matches, _, plan = _plan(spark, sf)
    claims, subjects = _claims(spark, sf)
    encoded = evidence.encode(matches, claims, subjects)
    run = models.logistic_family(evidence=encoded).run(matches, plan)
    return run.predictions.select("fold_index", "match_id", _r("p_a", 4))


@query("logreg_coefficients")
def logreg_coefficients(spark, sf):
    matches, _, plan = _plan(spark, sf)
    return models.logistic_family().run(matches, plan).params.select(
        "fold_index", "name", _r("value", 4)
    )


@query(
    "logreg_gradient",
    with_ctes(
        f"""SELECT DISTINCT CAST(t.fold_index AS BIGINT) AS fold_index, n.name, 0.0::DOUBLE AS gradient
FROM matches m JOIN eligible e USING (event_id) JOIN tested t ON e.position < t.position,
  LATERAL (SELECT unnest([{", ".join(f"'{n}'" for n in models.NUMERIC)}, 'intercept',
    'arm=' || m.arm, 'weight_class=' || m.weight_class]) AS name) n""",
        DYADS, SIDES, FOLDS,
    ),
)
def logreg_gradient(spark, sf):
    """What a fitted fold's weights leave of the penalised gradient, and which names it has learned."""
    matches, _, plan = _plan(spark, sf)
    # the rows the folds are fitted on, made once for both
    train, test = models.placed_inputs(*models.tabular_inputs(models._eligible(matches, plan)), plan)
    run = models.logistic_family(placed=(train, test)).run(matches, plan)
    slopes = models.logistic_gradient(train.drop("fold_index"), run.params, models._folds(plan))
    return slopes.select("fold_index", "name", (F.round("gradient", 6) + 0.0).alias("gradient"))


# the climb of every fold at once, over the results of its training events
_BRADLEY_TERRY_FOLDS = """
fold_results AS MATERIALIZED (
  SELECT t.fold_index, s.athlete_id, s.opponent_id, count(*) AS games, sum(s.won) AS wins
  FROM sides s JOIN eligible e USING (event_id) JOIN tested t ON e.position < t.position GROUP BY 1, 2, 3),
fold_climb AS (
  SELECT 0 AS i, fold_index, athlete_id, 0.0::DOUBLE AS theta
  FROM (SELECT DISTINCT fold_index, athlete_id FROM fold_results)
  UNION ALL
  SELECT i, fold_index, athlete_id, raw - avg(raw) OVER (PARTITION BY fold_index) FROM (
    SELECT s.i + 1 AS i, s.fold_index, s.athlete_id,
      any_value(s.theta) + (sum(r.wins - r.games / (1.0 + exp(-(s.theta - o.theta))))
        - 2.0 * any_value(s.theta)) / (2.0 + sum(r.games) / 2.0) AS raw
    FROM fold_climb s JOIN fold_results r ON r.athlete_id = s.athlete_id AND r.fold_index = s.fold_index
    JOIN fold_climb o ON o.athlete_id = r.opponent_id AND o.fold_index = s.fold_index
    WHERE s.i < 240 GROUP BY s.i, s.fold_index, s.athlete_id)),
strengths AS (SELECT fold_index, athlete_id, theta FROM fold_climb WHERE i = 240)
""".strip()


@query(
    "bradley_terry_folds",
    with_recursive(
        """SELECT t.fold_index, m.match_id,
  round(1.0 / (1.0 + exp(-(coalesce(a.theta, 0.0) - coalesce(b.theta, 0.0)))), 4) AS p_a
FROM matches m JOIN tested t USING (event_id)
LEFT JOIN strengths a ON a.fold_index = t.fold_index AND a.athlete_id = m.athlete_a_id
LEFT JOIN strengths b ON b.fold_index = t.fold_index AND b.athlete_id = m.athlete_b_id""",
        DYADS, SIDES, FOLDS, _BRADLEY_TERRY_FOLDS,
    ),
)
def bradley_terry_folds(spark, sf):
    matches, _, plan = _plan(spark, sf)
    run = models.bradley_terry_family().run(matches, plan)
    return run.predictions.select("fold_index", "match_id", _r("p_a", 4))


# ---------------------------------------------------------------- comparison and calibration

PREDICTIONS = """
forecasts AS (
  SELECT match_id, athlete_a_id, athlete_b_id, result_a = 'win' AS a_won,
    0.05 + 0.9 * ((match_id * 37) % 101) / 100.0 AS p_1,
    0.05 + 0.9 * ((match_id * 53 + CASE WHEN result_a = 'win' THEN 30 ELSE 0 END) % 101) / 100.0 AS p_2,
    0.05 + 0.9 * ((match_id * 71 + 13) % 101) / 100.0 AS p_3 FROM matches)
""".strip()


def forecasts(matches: DataFrame) -> DataFrame:
    """Three made-up forecasters, two of them blind, one that partly knows."""
    unit = lambda c: F.lit(0.05) + F.lit(0.9) * (c % 101) / F.lit(100.0)
    a_won = F.col("result_a") == "win"
    return matches.select(
        "match_id", "athlete_a_id", "athlete_b_id", a_won.alias("a_won"), "result_a", "arm",
        "weight_class",
        unit(F.col("match_id") * 37).alias("p_1"),
        unit(F.col("match_id") * 53 + F.when(a_won, 30).otherwise(0)).alias("p_2"),
        unit(F.col("match_id") * 71 + 13).alias("p_3"),
    )


def _run(rows: DataFrame, column: str) -> DataFrame:
    return ledger.prediction_rows(rows.withColumn("p_a", F.col(column)))


@query(
    "prediction_rows",
    with_ctes(
        """SELECT match_id, athlete_a_id AS athlete_id, round(p_1, 6) AS p_win FROM forecasts
UNION ALL SELECT match_id, athlete_b_id, round(1.0 - p_1, 6) FROM forecasts""",
        DYADS, PREDICTIONS,
    ),
)
def prediction_rows(spark, sf):
    return _run(forecasts(fx.completed(spark, sf)), "p_1").select(
        "match_id", "athlete_id", _r("p_win")
    )


@query(
    "paired_compare",
    with_ctes(
        "SELECT match_id, a_won, round(p_1, 6) AS p_run_a, round(p_2, 6) AS p_run_b FROM forecasts",
        DYADS, PREDICTIONS,
    ),
)
def paired_compare(spark, sf):
    rows = forecasts(_completed(spark, sf))
    matches = rows.select("match_id", "athlete_a_id", "result_a")
    return stats.paired(matches, _run(rows, "p_1"), _run(rows, "p_2")).select(
        "match_id", "a_won", _r("p_run_a"), _r("p_run_b")
    )


_MCNEMAR = """
counted AS (
  SELECT arm, count(*) AS n,
    round(avg(CASE WHEN (p_1 >= 0.5) = a_won THEN 1.0 ELSE 0.0 END), 6) AS accuracy_a,
    round(avg(CASE WHEN (p_2 >= 0.5) = a_won THEN 1.0 ELSE 0.0 END), 6) AS accuracy_b,
    count(*) FILTER (WHERE (p_1 >= 0.5) = a_won AND (p_2 >= 0.5) <> a_won) AS a_right_b_wrong,
    count(*) FILTER (WHERE (p_2 >= 0.5) = a_won AND (p_1 >= 0.5) <> a_won) AS b_right_a_wrong
  FROM forecasts JOIN matches USING (match_id) GROUP BY arm),
tails AS (
  SELECT arm, sum(exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) - d * ln(2))) AS tail
  FROM (SELECT arm, (a_right_b_wrong + b_right_a_wrong)::DOUBLE AS d,
      unnest(range(0, least(a_right_b_wrong, b_right_a_wrong) + 1)) AS i FROM counted) GROUP BY arm)
""".strip()


@query(
    "mcnemar",
    with_ctes(
        """SELECT arm, n, accuracy_a, accuracy_b, a_right_b_wrong, b_right_a_wrong,
  round(CASE WHEN a_right_b_wrong + b_right_a_wrong = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6)
    AS mcnemar_p_value
FROM counted LEFT JOIN tails USING (arm)""",
        DYADS, PREDICTIONS, _MCNEMAR,
    ),
)
def mcnemar(spark, sf):
    rows = forecasts(fx.completed(spark, sf))
    pairs = rows.select(
        "match_id", "arm", "a_won", F.col("p_1").alias("p_run_a"), F.col("p_2").alias("p_run_b")
    )
    return stats.discordance(pairs, ["arm"]).select(
        "arm", "n", _r("accuracy_a"), _r("accuracy_b"), "a_right_b_wrong", "b_right_a_wrong",
        _r("mcnemar_p_value"),
    )


_WEIGHT = " + ".join(f"(x >= {t})::INT" for t in stats.poisson_thresholds())
_BOOTSTRAP = f"""
diffs AS (
  SELECT match_id, -ln(CASE WHEN a_won THEN p_1 ELSE 1 - p_1 END)
    + ln(CASE WHEN a_won THEN p_2 ELSE 1 - p_2 END) AS d, match_id % {stats.HASH_PRIME} AS rid,
    (match_id // {stats.HASH_PRIME}) % {stats.HASH_PRIME} AS hi FROM forecasts),
mixed1 AS (SELECT d, rid, hi, b, (rid * {stats.HASH_ID} + hi * {stats.HASH_HIGH} + b * {stats.HASH_DRAW} + 12345)
    % {stats.HASH_PRIME} AS x
  FROM diffs, range(0, 2000) t(b)),
mixed2 AS (SELECT d, rid, hi, b, (x * x + b + 1) % {stats.HASH_PRIME} AS x FROM mixed1),
mixed3 AS (SELECT d, b, (x * x + rid + hi) % {stats.HASH_PRIME} AS x FROM mixed2),
weights AS (SELECT d, b, {_WEIGHT} AS w FROM mixed3),
means AS (SELECT b, sum(w * d) / sum(w) AS m FROM weights GROUP BY b),
sorted AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM means)
""".strip()


@query(
    "bootstrap_ci",
    with_ctes(
        """SELECT round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, NOT (lo <= 0 AND hi >= 0) AS distinguishable
FROM (SELECT max(m) FILTER (WHERE r = 50) AS lo, max(m) FILTER (WHERE r = 1950) AS hi FROM sorted)""",
        DYADS, PREDICTIONS, _BOOTSTRAP,
    ),
)
def bootstrap_ci(spark, sf):
    rows = forecasts(fx.completed(spark, sf))
    pairs = rows.select(
        "match_id", "a_won", F.col("p_1").alias("p_run_a"), F.col("p_2").alias("p_run_b")
    )
    return stats.bootstrap_interval(pairs).select(_r("ci_lower"), _r("ci_upper"), "distinguishable")


@query(
    "wilson",
    with_ctes(
        _sql_metrics(
            "weight_class",
            "(SELECT weight_class, p_2 AS p_a, a_won FROM forecasts JOIN matches USING (match_id))",
        ),
        DYADS, PREDICTIONS,
    ),
)
def wilson(spark, sf):
    rows = forecasts(fx.completed(spark, sf))
    return stats.metrics(rows.withColumn("p_a", F.col("p_2")), ["weight_class"]).select(
        "weight_class", "n", *[_r(c) for c in _METRIC_COLUMNS]
    )


@query(
    "calibration_buckets",
    with_ctes(
        """SELECT least(floor((greatest(p_2, 1 - p_2) - 0.5) * 10)::BIGINT, 4) AS bucket, count(*) AS n,
  count(*) FILTER (WHERE (p_2 >= 0.5) = a_won) AS hits,
  round(avg(greatest(p_2, 1 - p_2)), 6) AS mean_confidence,
  round(count(*) FILTER (WHERE (p_2 >= 0.5) = a_won) / count(*), 6) AS hit_rate
FROM forecasts GROUP BY 1""",
        DYADS, PREDICTIONS,
    ),
)
def calibration_buckets(spark, sf):
    rows = forecasts(fx.completed(spark, sf)).withColumn("p_a", F.col("p_2"))
    return stats.calibration(rows).select(
        "bucket", "n", "hits", _r("mean_confidence"), _r("hit_rate")
    )


@query(
    "consensus",
    with_ctes(
        """SELECT 3::BIGINT AS voters, greatest(votes, 3 - votes)::BIGINT AS majority, count(*) AS matches,
  count(*) FILTER (WHERE (votes * 2 >= 3) = a_won) AS hits,
  round(count(*) FILTER (WHERE (votes * 2 >= 3) = a_won) / count(*), 6) AS hit_rate
FROM (SELECT a_won, (p_1 >= 0.5)::INT + (p_2 >= 0.5)::INT + (p_3 >= 0.5)::INT AS votes FROM forecasts)
GROUP BY 2""",
        DYADS, PREDICTIONS,
    ),
)
def consensus(spark, sf):
    rows = forecasts(fx.completed(spark, sf))
    long = rows.select(
        "match_id", "a_won",
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("forecaster"), (F.col(f"p_{i}") >= 0.5).alias("picks_a"))
                for i in (1, 2, 3)
            ])
        ).alias("f"),
    ).select("match_id", "a_won", "f.*")
    return stats.consensus(long).select(
        "voters", F.col("majority").cast("long").alias("majority"), "matches", "hits", _r("hit_rate")
    )


# ---------------------------------------------------------------- ledger


@query(
    "prediction_outcomes",
    with_ctes(
        """SELECT d.match_id, s.athlete_id, CASE WHEN d.status <> 'completed' THEN NULL
    WHEN s.athlete_id = d.athlete_a_id THEN d.result_a
    WHEN d.result_a = 'win' THEN 'loss' ELSE 'win' END AS outcome
FROM dyads d, LATERAL (SELECT unnest([d.athlete_a_id, d.athlete_b_id]) AS athlete_id) s""",
        DYADS,
    ),
)
def prediction_outcomes(spark, sf):
    everything = stage(fx.dyads(spark, sf), "dyads")
    rows = _run(everything.withColumn("p_1", F.lit(0.5)), "p_1")
    matches = everything.where("status = 'completed'")
    return ledger.outcomes(rows, matches).select("match_id", "athlete_id", "outcome")


@query(
    "fold_report",
    with_ctes(
        """SELECT fold_index, count(*) AS test_count,
  count(*) FILTER (WHERE match_id % 3 <> 0) AS predicted_match_count,
  array_to_string(list_sort(list(DISTINCT strftime(held_on, '%Y-%m-%d'))), ',') AS test_event_dates
FROM members JOIN matches USING (match_id) WHERE role = 'test' GROUP BY 1""",
        DYADS, FOLDS, MEMBERS,
    ),
)
def fold_report(spark, sf):
    matches, _, plan = _plan(spark, sf)
    members = folds.fold_members(plan, matches)
    predicted = matches.where("match_id % 3 <> 0")
    return ledger.fold_report(members, matches, predicted).select(
        F.col("fold_index").cast("long").alias("fold_index"), "test_count", "predicted_match_count",
        F.array_join(
            F.transform("test_event_dates", lambda d: F.date_format(d, "yyyy-MM-dd")), ","
        ).alias("test_event_dates"),
    )


@query(
    "fold_cutoffs",
    with_ctes(
        """SELECT fold_index, strftime(max(scheduled_at), '%Y-%m-%d') AS cutoff
FROM members JOIN matches USING (match_id) WHERE role = 'train' GROUP BY 1""",
        DYADS, FOLDS, MEMBERS,
    ),
)
def fold_cutoffs(spark, sf):
    matches, _, plan = _plan(spark, sf)
    return ledger.plan_cutoffs(plan, matches).select(
        F.col("fold_index").cast("long").alias("fold_index"), _day("cutoff")
    )


_PAYLOADS = """
payloads AS (
  SELECT fold_index, role, match_id, concat_ws('|', 'arm=' || arm, 'athlete_a_id=' || athlete_a_id,
    'athlete_a_won=' || CASE WHEN role = 'test' THEN 'null' WHEN result_a = 'win' THEN 'true' ELSE 'false' END,
    'athlete_b_id=' || athlete_b_id, 'match_id=' || match_id, 'missingness=not_applicable',
    'scheduled_at=' || strftime(scheduled_at, '%Y-%m-%d %H:%M:%S')) AS payload
  FROM members JOIN matches USING (match_id)),
hashed AS (SELECT *, sha256(payload) AS payload_sha256 FROM payloads)
""".strip()


@query(
    "rating_payloads",
    with_ctes(
        "SELECT fold_index, role, match_id, payload, payload_sha256 FROM hashed",
        DYADS, FOLDS, MEMBERS, _PAYLOADS,
    ),
)
def rating_payloads(spark, sf):
    matches, _, plan = _plan(spark, sf)
    members = folds.fold_members(plan, ledger.with_inputs(matches), *ledger.INPUTS)
    return ledger.rating_payloads(members).withColumn("fold_index", F.col("fold_index").cast("long"))


_PIECES = ", ".join(
    f"sum(('0x' || substr(payload_sha256, {1 + 15 * i}, 15))::BIGINT) AS p{i}" for i in range(5)
)


@query(
    "manifest_hash",
    with_ctes(
        f"""SELECT fold_index, feature_rows, train_rows, test_rows,
  sha256(concat_ws('|', feature_rows, p0, p1, p2, p3, p4)) AS manifest_sha256
FROM (SELECT fold_index, count(*) AS feature_rows, count(*) FILTER (WHERE role = 'train') AS train_rows,
    count(*) FILTER (WHERE role = 'test') AS test_rows, {_PIECES} FROM hashed GROUP BY 1)""",
        DYADS, FOLDS, MEMBERS, _PAYLOADS,
    ),
)
def manifest_hash(spark, sf):
    matches, _, plan = _plan(spark, sf)
    return ledger.rating_manifests(plan, matches).withColumn("fold_index", F.col("fold_index").cast("long"))


def _payload_sql(role: str, mid: str, late: str, form: str, pair: str) -> str:
    both = lambda name, c: ", ".join(
        f"'{name}_{t}=' || printf('%.6f', round({c.format(t=t)}, 6))" for t in "ab"
    )
    return f"""SELECT m.match_id, '{role}' AS role, sha256(concat_ws('|', 'arm=' || m.arm,
    {both('days_since_last_match', '{t}.days_since_last_match')},
    'head_to_head_diff=' || printf('%.6f', h.head_to_head_diff){mid},
    {both('prior_rating', 'e.prior_{t}')}, {both('recent_form', '{t}.recent_form')}{late},
    'weight_class=' || m.weight_class, {both('win_rate', '{t}.win_rate')})) AS payload_sha256
FROM matches m JOIN elo e USING (match_id) JOIN {pair} h USING (match_id)
JOIN {form} a ON a.match_id = m.match_id AND a.side = 'a'
JOIN {form} b ON b.match_id = m.match_id AND b.side = 'b'"""


@query(
    "history_payloads",
    with_recursive(
        _payload_sql("train", ",\n    'label=' || CASE WHEN m.result_a = 'win' THEN '1.0' ELSE '0.0' END", "", "history", "h2h")
        + "\nUNION ALL\n"
        + _payload_sql(
            "test", "", ",\n    'scheduled_at=' || strftime(m.scheduled_at, '%Y-%m-%d %H:%M:%S')", "at_event_form", "at_event_h2h"
        ),
        DYADS, SIDES, HISTORY, HEAD_TO_HEAD, ASOF, ELO,
    ),
)
def history_payloads(spark, sf):
    train, test = models.tabular_inputs(_completed(spark, sf))
    rows = ledger.history_payloads(train, "train").unionByName(ledger.history_payloads(test, "test"))
    return rows.select("match_id", "role", "payload_sha256")


@query(
    "explain_defaults",
    with_ctes(
        """SELECT match_id, array_to_string(list_sort(list_filter([
    CASE WHEN meetings = 0 THEN 'head_to_head_diff' END,
    CASE WHEN na = 0 THEN 'prior_rating_a' END, CASE WHEN na = 0 THEN 'recent_form_a' END,
    CASE WHEN na = 0 THEN 'win_rate_a' END, CASE WHEN na = 0 THEN 'days_since_last_match_a' END,
    CASE WHEN nb = 0 THEN 'prior_rating_b' END, CASE WHEN nb = 0 THEN 'recent_form_b' END,
    CASE WHEN nb = 0 THEN 'win_rate_b' END, CASE WHEN nb = 0 THEN 'days_since_last_match_b' END],
    lambda x: x IS NOT NULL)), ',') AS defaulted_features
FROM (SELECT m.match_id, a.prior_matches AS na, b.prior_matches AS nb,
    count(*) OVER (PARTITION BY m.athlete_a_id, m.athlete_b_id ORDER BY m.scheduled_at, m.match_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS meetings
  FROM matches m JOIN history a ON a.match_id = m.match_id AND a.side = 'a'
  JOIN history b ON b.match_id = m.match_id AND b.side = 'b')""",
        DYADS, SIDES, HISTORY,
    ),
)
def explain_defaults(spark, sf):
    matches = _completed(spark, sf)
    meetings = running_before(
        matches, features.PAIR, dy.MATCH_ORDER, sums={"prior_meetings": F.lit(1)}
    ).select("match_id", "prior_meetings")
    rows = features.history_features(matches).join(meetings, "match_id")
    return ledger.defaulted_features(rows).select(
        "match_id", F.array_join("defaulted_features", ",").alias("defaulted_features")
    )


# a ledger of runs made from the supplier table: one run per supplier, protocols from nations
_RUNS = """
runs AS (SELECT s_suppkey AS run_id, CAST(s_nationkey AS BIGINT) AS protocol_id, s_acctbal < 0 AS git_dirty,
    CAST(s_suppkey % 2 + 1 AS BIGINT) AS feature_spec_id FROM supplier),
protocols AS (SELECT CAST(n_nationkey AS BIGINT) AS protocol_id, n_name AS protocol_name,
    CASE WHEN n_regionkey = 0 THEN 'lockbox_retrospective' ELSE 'rolling_origin' END AS kind FROM nation),
specs AS (SELECT CAST(r_regionkey AS BIGINT) AS feature_spec_id, r_name AS spec_name FROM region),
manifests AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS run_id, count(*) AS feature_rows
  FROM customer GROUP BY 1),
fitted AS (SELECT CAST(p_partkey AS BIGINT) AS run_id, p_name AS model FROM part WHERE p_size > 25)
""".strip()


def _ledger_tables(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    runs = t("supplier").select(
        F.col("s_suppkey").alias("run_id"), F.col("s_nationkey").cast("long").alias("protocol_id"),
        (F.col("s_acctbal") < 0).alias("git_dirty"),
        (F.col("s_suppkey") % 2 + 1).cast("long").alias("feature_spec_id"),
    )
    kind = F.when(F.col("n_regionkey") == 0, "lockbox_retrospective").otherwise("rolling_origin")
    protocols = t("nation").select(
        F.col("n_nationkey").cast("long").alias("protocol_id"),
        F.col("n_name").alias("protocol_name"), kind.alias("kind"),
    )
    specs = t("region").select(
        F.col("r_regionkey").cast("long").alias("feature_spec_id"), F.col("r_name").alias("spec_name")
    )
    n_runs = t("supplier").count()
    manifests = (
        t("customer")
        .groupBy((F.col("c_custkey") % n_runs).alias("run_id"))
        .agg(F.count(F.lit(1)).alias("feature_rows"))
    )
    fitted = t("part").where("p_size > 25").select(
        F.col("p_partkey").cast("long").alias("run_id"), F.col("p_name").alias("model")
    )
    return runs, protocols, specs, manifests, fitted


@query(
    "run_report",
    with_ctes(
        """SELECT run_id, protocol_id, protocol_name, kind, spec_name, feature_rows, model,
  NOT git_dirty AS promotable
FROM runs JOIN protocols USING (protocol_id) JOIN specs USING (feature_spec_id)
JOIN manifests USING (run_id) LEFT JOIN fitted USING (run_id)""",
        _RUNS,
    ),
)
def run_report(spark, sf):
    return ledger.run_report(*_ledger_tables(spark, sf)).select(
        "run_id", "protocol_id", "protocol_name", "kind", "spec_name", "feature_rows", "model",
        "promotable",
    )


@query(
    "consultations",
    with_ctes(
        """SELECT p.protocol_id, p.kind, coalesce(c.n, 0) AS consultations,
  coalesce(f.train, 0) AS train_match_count, coalesce(f.test, 0) AS test_match_count
FROM protocols p LEFT JOIN (SELECT protocol_id, count(*) AS n FROM runs GROUP BY 1) c USING (protocol_id)
LEFT JOIN (SELECT match_id % 20 AS protocol_id,
    count(*) FILTER (WHERE event_id % 4 <> 0) AS train, count(*) FILTER (WHERE event_id % 4 = 0) AS test
  FROM matches GROUP BY 1) f USING (protocol_id)""",
        DYADS, _RUNS,
    ),
)
def consultations(spark, sf):
    runs, protocols, *_ = _ledger_tables(spark, sf)
    members = fx.completed(spark, sf).select(
        (F.col("match_id") % 20).alias("protocol_id"), "match_id",
        F.when(F.col("event_id") % 4 == 0, "test").otherwise("train").alias("role"),
    )
    return ledger.consultations(runs, protocols, members).select(
        "protocol_id", "kind", "consultations", "train_match_count", "test_match_count"
    )
