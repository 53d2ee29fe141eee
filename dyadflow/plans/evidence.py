"""Registered queries of the evidence track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions import recency, text, vocab
from dyadflow.operators import claims as cl
from dyadflow.operators import discovery as ds
from dyadflow.operators import evidence as ev
from dyadflow.operators import mechanisms as mech
from dyadflow.operators import stats, validation
from dyadflow.plans import fixtures as fx
from dyadflow.plans.fixtures import DYADS, table, with_ctes
from dyadflow.plans.prediction import PREDICTIONS, forecasts
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


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---------------------------------------------------------------- claims about athletes (events)

CLAIMS = """
athletes AS (SELECT count(*) AS n FROM supplier),
claims AS (
  SELECT event_id AS claim_id, event_type || props AS claim_text, event_id % 500 AS source_id,
    CASE WHEN event_id % 17 = 0 THEN NULL
      ELSE TIMESTAMP '1995-01-01' + to_days(CAST(event_id * 13 % 2400 AS INTEGER)) END AS published_at,
    CASE event_type WHEN 'error' THEN 'injury' WHEN 'click' THEN 'tactic' WHEN 'view' THEN 'form'
      WHEN 'signup' THEN 'setup' ELSE 'other' END AS claim_type
  FROM events),
annotated AS (SELECT * FROM claims WHERE claim_id % 3 <> 0),
subjects AS (
  SELECT event_id AS claim_id, user_id % n AS athlete_id FROM events, athletes
  UNION SELECT event_id, (user_id + 1) % n FROM events, athletes WHERE event_id % 5 = 0)
""".strip()


def raw_claims(spark: SparkSession, sf: str) -> DataFrame:
    day = F.make_interval(days=(F.col("event_id") * 13 % 2400).cast("int"))
    published = F.when(F.col("event_id") % 17 != 0, F.lit("1995-01-01").cast("timestamp") + day)
    kind = (
        F.when(F.col("event_type") == "error", "injury")
        .when(F.col("event_type") == "click", "tactic")
        .when(F.col("event_type") == "view", "form")
        .when(F.col("event_type") == "signup", "setup")
        .otherwise("other")
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("claim_id"),
        F.concat("event_type", "props").alias("claim_text"),
        (F.col("event_id") % 500).alias("source_id"),
        published.alias("published_at"),
        kind.alias("claim_type"),
    )


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    return raw_claims(spark, sf).where("claim_id % 3 <> 0").select(
        "claim_id", F.lit("m1").alias("model"), F.lit("v1").alias("prompt_version"), "claim_type"
    )


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    return ev.annotated_claims(
        raw_claims(spark, sf).drop("claim_type"), annotations(spark, sf), "m1", "v1"
    )


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "supplier").count()
    who = lambda shift: ((F.col("user_id") + shift) % n)
    both = F.when(F.col("event_id") % 5 == 0, F.array(who(0), who(1))).otherwise(F.array(who(0)))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("claim_id"), F.explode(both).alias("athlete_id")
    ).distinct()


_PAIRS = """
candidates AS (
  SELECT DISTINCT m.match_id, m.scheduled_at, c.claim_id, c.published_at, c.claim_type
  FROM matches m JOIN subjects s ON s.athlete_id IN (m.athlete_a_id, m.athlete_b_id)
  JOIN annotated c USING (claim_id)),
encoded AS (
  SELECT m.match_id, count(c.claim_id) FILTER (WHERE c.published_at < c.scheduled_at) AS evidence_count,
    coalesce(bool_or(c.claim_type = 'injury' AND c.published_at < c.scheduled_at
      AND epoch(c.scheduled_at - c.published_at) < 31 * 86400), false) AS recent_injury_flag,
    coalesce(bool_or(c.claim_type IN ('tactic', 'setup', 'opponent_comparison')
      AND c.published_at < c.scheduled_at), false) AS technique_advantage_flag,
    count(c.claim_id) FILTER (WHERE c.published_at IS NULL) AS unknown_time_count,
    count(c.claim_id) FILTER (WHERE c.published_at >= c.scheduled_at) AS too_late_count
  FROM matches m LEFT JOIN candidates c USING (match_id) GROUP BY 1)
""".strip()


def _encoded(spark, sf) -> DataFrame:
    matches = stage(fx.completed(spark, sf), "matches")
    return ev.encode(matches, annotated(spark, sf), subjects(spark, sf))


@query(
    "evidence_encoding",
    with_ctes(
        """SELECT match_id, evidence_count, recent_injury_flag, technique_advantage_flag FROM encoded""",
        DYADS, CLAIMS, _PAIRS,
    ),
)
def evidence_encoding(spark, sf):
    return _encoded(spark, sf).select(
        "match_id", *_long("evidence_count"), "recent_injury_flag", "technique_advantage_flag"
    )


@query(
    "evidence_reasons",
    with_ctes(
        "SELECT match_id, evidence_count, unknown_time_count, too_late_count FROM encoded",
        DYADS, CLAIMS, _PAIRS,
    ),
)
def evidence_reasons(spark, sf):
    return _encoded(spark, sf).select(
        "match_id", *_long("evidence_count", "unknown_time_count", "too_late_count")
    )


@query(
    "covered_compare",
    with_ctes(
        """SELECT count(*) AS n, round(avg(((p_1 >= 0.5) = a_won)::INT), 6) AS accuracy_a,
  round(avg(((p_2 >= 0.5) = a_won)::INT), 6) AS accuracy_b
FROM forecasts JOIN encoded USING (match_id) WHERE evidence_count > 0""",
        DYADS, CLAIMS, _PAIRS, PREDICTIONS,
    ),
)
def covered_compare(spark, sf):
    rows = forecasts(fx.completed(spark, sf)).select(
        "match_id", "a_won", F.col("p_1").alias("p_run_a"), F.col("p_2").alias("p_run_b")
    )
    covered = ev.covered_matches(_encoded(spark, sf))
    return stats.discordance(rows.join(covered, "match_id", "left_semi")).select(
        "n", _r("accuracy_a"), _r("accuracy_b")
    )


@query(
    "missing_annotations",
    with_ctes("SELECT claim_id, claim_text FROM claims WHERE claim_id % 3 = 0", CLAIMS),
)
def missing_annotations(spark, sf):
    return ev.missing_annotations(
        raw_claims(spark, sf), annotations(spark, sf), "m1", "v1"
    ).select("claim_id", "claim_text")


@query(
    "annotated_by_rule",
    """SELECT event_id AS claim_id, CASE WHEN event_type = 'error' THEN 'injury' WHEN event_type = 'click' THEN 'tactic'
    WHEN event_type = 'signup' THEN 'setup' WHEN event_type = 'view' THEN 'form' ELSE 'other' END AS claim_type,
  CASE WHEN event_type = 'error' THEN 'injury_or_recovery_status' WHEN event_type = 'click' THEN 'hook'
    WHEN event_type = 'signup' THEN 'start_position' ELSE 'training_regimen' END AS concepts
FROM events WHERE event_id % 3 = 0""",
)
def annotated_by_rule(spark, sf):
    missing = ev.missing_annotations(raw_claims(spark, sf), annotations(spark, sf), "m1", "v1")
    checked = validation.annotation_problems(cl.annotate(missing))
    return validation.accepted(checked).select(
        "claim_id", "claim_type", F.array_join("concepts", ",").alias("concepts")
    )


_RAW_ANNOTATIONS = """
raw AS (
  SELECT event_id AS claim_id, CASE WHEN event_id % 11 = 0 THEN 'rumour' ELSE 'form' END AS claim_type,
    CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 13 = 0 THEN ['hook', 'magic'] ELSE ['hook', 'press'] END AS concepts,
    CASE WHEN event_id % 19 = 0 THEN 'both' ELSE 'unclear' END AS arm,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'unclear' END AS temporality,
    CASE WHEN event_id % 29 = 0 THEN 'sure' ELSE 'observed' END AS certainty
  FROM events)
""".strip()


@query(
    "annotation_rules",
    with_ctes(
        """SELECT claim_id, array_to_string(list_sort(list_filter([
    CASE WHEN claim_type <> 'form' THEN 'unrecognized claim_type' END,
    CASE WHEN len(concepts) = 0 THEN 'annotation requires at least one concept' END,
    CASE WHEN list_contains(concepts, 'magic') THEN 'unrecognized concept' END,
    CASE WHEN arm = 'both' THEN 'unrecognized arm' END,
    CASE WHEN temporality IS NULL THEN 'unrecognized temporality' END,
    CASE WHEN certainty = 'sure' THEN 'unrecognized certainty' END], lambda x: x IS NOT NULL)), '; ') AS problems
FROM raw""",
        _RAW_ANNOTATIONS,
    ),
)
def annotation_rules(spark, sf):
    i = F.col("event_id")
    words = lambda *w: F.array(*map(F.lit, w))
    raw = table(spark, sf, "events").select(
        i.alias("claim_id"),
        F.when(i % 11 == 0, "rumour").otherwise("form").alias("claim_type"),
        F.when(i % 7 == 0, F.array().cast("array<string>"))
        .when(i % 13 == 0, words("hook", "magic"))
        .otherwise(words("hook", "press"))
        .alias("concepts"),
        F.when(i % 19 == 0, "both").otherwise("unclear").alias("arm"),
        F.when(i % 23 != 0, "unclear").alias("temporality"),
        F.when(i % 29 == 0, "sure").otherwise("observed").alias("certainty"),
    )
    return validation.annotation_problems(raw).select(
        "claim_id", F.array_join("problems", "; ").alias("problems")
    )


# ---------------------------------------------------------------- claims in documents

AS_OF = "2026-04-26"

DOC_CLAIMS = f"""
doc_claims AS (
  SELECT doc_id, source AS video_id, lang AS dossier, doc_id % 2 AS file_ord, doc_id AS pos,
    '00:' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS timestamp, text AS claim,
    CASE WHEN doc_id % 19 = 0 THEN NULL ELSE TIMESTAMP '{AS_OF} 12:00:00'
      - to_days(CAST(doc_id * 7 % 1500 AS INTEGER)) END AS published
  FROM documents),
aged AS (
  SELECT *, greatest(0, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published)) / 86400000000.0) AS BIGINT)) AS raw_age
  FROM doc_claims),
recent AS (
  SELECT *, CASE WHEN published IS NULL THEN NULL ELSE raw_age END AS age_days,
    CASE WHEN published IS NULL THEN 'unknown' WHEN raw_age <= 180 THEN 'current_window'
      WHEN raw_age <= 730 THEN 'recent_context' ELSE 'historical_context' END AS source_recency
  FROM aged),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dossier, video_id, timestamp, claim
    ORDER BY file_ord, pos) AS r FROM recent) WHERE r = 1),
deduped AS (
  SELECT *, row_number() OVER (PARTITION BY dossier ORDER BY file_ord, pos) - 1 AS evidence_index
  FROM firsts)
""".strip()


def doc_claims(spark: SparkSession, sf: str) -> DataFrame:
    back = F.make_interval(days=(F.col("doc_id") * 7 % 1500).cast("int"))
    published = F.when(
        F.col("doc_id") % 19 != 0, F.lit(f"{AS_OF} 12:00:00").cast("timestamp") - back
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("video_id"), F.col("lang").alias("dossier"),
        (F.col("doc_id") % 2).alias("file_ord"), F.col("doc_id").alias("pos"),
        text.format_seconds(F.col("n_chars") % 60).alias("timestamp"),
        F.col("text").alias("claim"),
        F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
    )


def _recent(rows: DataFrame) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    age = recency.age_days(recency.published_at("published_at"), as_of)
    bucketed = rows.withColumn("age_days", age).withColumn("source_recency", recency.bucket("age_days"))
    return bucketed.withColumn(
        "current_form_allowed", recency.current_form_allowed("source_recency")
    )


def _deduped(spark, sf) -> DataFrame:
    # the dedupe key holds a digest of the text, so texts are not shuffled around to compare them
    rows = _recent(doc_claims(spark, sf)).withColumn("claim_sha", F.sha2("claim", 256)).drop("claim")
    staged = stage(rows, "claims")
    return cl.dedupe_claims(staged, ["dossier"], ("video_id", "timestamp", "claim_sha"))


@query(
    "claims_dedup",
    with_ctes(
        "SELECT dossier, evidence_index, doc_id, sha256(claim) AS claim_sha FROM deduped", DOC_CLAIMS
    ),
)
def claims_dedup(spark, sf):
    return _deduped(spark, sf).select("dossier", *_long("evidence_index"), "doc_id", "claim_sha")


@query(
    "claim_batches",
    with_ctes(
        """SELECT dossier, doc_id, evidence_index // 25 + 1 AS dimension_batch,
  evidence_index // 30 + 1 AS atom_batch FROM deduped""",
        DOC_CLAIMS,
    ),
)
def claim_batches(spark, sf):
    return _deduped(spark, sf).select(
        "dossier", "doc_id",
        cl.batch_index("evidence_index", vocab.DIMENSION_BATCH).alias("dimension_batch"),
        cl.batch_index("evidence_index", vocab.ATOM_BATCH).alias("atom_batch"),
    )


@query(
    "recency_buckets",
    with_ctes("SELECT doc_id, age_days, source_recency FROM recent", DOC_CLAIMS),
)
def recency_buckets(spark, sf):
    return _recent(doc_claims(spark, sf)).select("doc_id", "age_days", "source_recency")


@query(
    "claim_roles",
    with_ctes(
        """SELECT doc_id, source_recency = 'current_window' AS current_form_allowed,
  CASE WHEN source_recency = 'current_window' THEN 'current_form,durable_style,historical_context'
    ELSE 'durable_style,historical_context,not_current_form' END AS roles FROM recent""",
        DOC_CLAIMS,
    ),
)
def claim_roles(spark, sf):
    return _recent(doc_claims(spark, sf)).select(
        "doc_id", "current_form_allowed",
        F.array_join(recency.roles("source_recency"), ",").alias("roles"),
    )


@query(
    "normalized_claims",
    with_ctes(
        """SELECT doc_id, sha256(claim) AS claim_sha, timestamp,
  'https://video.example/' || video_id || '&t=' || CAST(substr(timestamp, 4) AS INTEGER) || 's' AS source_url,
  'unknown' AS speaker_or_source, age_days AS source_age_days, source_recency FROM recent""",
        DOC_CLAIMS,
    ),
)
def normalized_claims(spark, sf):
    rows = doc_claims(spark, sf).select(
        F.col("doc_id").cast("string").alias("video_id"), F.col("video_id").alias("video_title"),
        F.lit("c").alias("channel"),
        F.concat(F.lit("https://video.example/"), "video_id").alias("url"), "published_at",
        "timestamp", "claim", F.lit(None).cast("string").alias("speaker_or_source"),
        F.lit(None).cast("string").alias("relevance"), F.lit("high").alias("confidence"),
        F.lit("m").alias("selected_model"),
    )
    return cl.normalize_claims(rows, F.lit(AS_OF)).select(
        F.col("video_id").cast("long").alias("doc_id"), F.sha2("claim", 256).alias("claim_sha"),
        "timestamp", "source_url", "speaker_or_source", "source_age_days", "source_recency",
    )


_WEIGHTED = r"""
weighted AS (
  SELECT doc_id, lower(text || CASE doc_id % 4
    WHEN 0 THEN ' body weight ' || CAST(60 + doc_id % 80 AS VARCHAR) || ' kg'
    WHEN 1 THEN ' back pressure with 80-' || CAST(85 + doc_id % 10 AS VARCHAR) || ' kg and 40kg'
    WHEN 2 THEN ' pronation 35 kg, competing at 95 KG'
    ELSE ' nothing measured' END) AS body FROM documents),
measured AS (
  SELECT doc_id, body, list_distinct(list_transform(list_zip(
      regexp_extract_all(body, '\b(\d{2,3})(?:\s*-\s*(\d{2,3}))?\s*kg\b', 1),
      regexp_extract_all(body, '\b(\d{2,3})(?:\s*-\s*(\d{2,3}))?\s*kg\b', 2)),
    lambda p: CASE WHEN coalesce(p[2], '') = '' THEN p[1] ELSE p[1] || '-' || p[2] END)) AS kg FROM weighted)
""".strip()


def _weighted(spark, sf) -> DataFrame:
    number = lambda c: c.cast("string")
    d = F.col("doc_id")
    suffix = (
        F.when(d % 4 == 0, F.concat(F.lit(" body weight "), number(60 + d % 80), F.lit(" kg")))
        .when(d % 4 == 1, F.concat(F.lit(" back pressure with 80-"), number(85 + d % 10), F.lit(" kg and 40kg")))
        .when(d % 4 == 2, F.lit(" pronation 35 kg, competing at 95 KG"))
        .otherwise(F.lit(" nothing measured"))
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.lower(F.concat("text", suffix)).alias("_text")
    )


@query(
    "kg_values",
    with_ctes(
        "SELECT doc_id, array_to_string(list_sort(kg), ',') AS kg_values FROM measured", _WEIGHTED
    ),
)
def kg_values(spark, sf):
    return cl.with_text_values(_weighted(spark, sf)).select(
        "doc_id", F.array_join(F.array_sort("kg_values"), ",").alias("kg_values")
    )


def _sql_lifts() -> str:
    parts = ", ".join(
        f"CASE WHEN contains(body, '{k}') THEN list_transform(kg, lambda v: '{n}=' || v) ELSE [] END"
        for k, n in vocab.LIFT_KEYWORDS.items()
    )
    return f"list_distinct(flatten([{parts}]))"


@query(
    "lift_rules",
    with_ctes(
        f"""SELECT doc_id, array_to_string(list_sort(weights), ',') AS measurements,
  array_to_string(list_sort(lifts), ',') AS lifts,
  CASE WHEN len(weights) > 0 THEN 'measurement' WHEN len(lifts) > 0 THEN 'gym_lift_proxy' ELSE 'unclear' END
    AS evidence_kind
FROM (SELECT doc_id, CASE WHEN contains(body, 'body weight') OR contains(body, 'current weight')
      OR contains(body, 'competing at') THEN list_transform(kg, lambda v: 'body_weight=' || v) ELSE [] END AS weights,
    {_sql_lifts()} AS lifts FROM measured)""",
        _WEIGHTED,
    ),
)
def lift_rules(spark, sf):
    rows = cl.with_text_values(_weighted(spark, sf))
    return rows.select(
        "doc_id", F.array_join(F.array_sort("text_measurements"), ",").alias("measurements"),
        F.array_join(F.array_sort("text_lifts"), ",").alias("lifts"),
        cl.promoted_kind(F.lit("unclear")).alias("evidence_kind"),
    )


# ---------------------------------------------------------------- model results per video

_RESULTS = """
results AS (
  SELECT doc_id // 4 AS video_id, ['cheap-1', 'cheap-2', 'gemini-2.5-flash-baseline', 'other'][doc_id % 4 + 1] AS model,
    CASE WHEN quality = 1 THEN ' Pass' WHEN quality = 0 THEN 'fail' END AS pass_fail, n_chars
  FROM documents LEFT JOIN labels USING (doc_id))
""".strip()


def _results(spark, sf) -> DataFrame:
    models = F.array(*map(F.lit, ("cheap-1", "cheap-2", cl.BASELINE_MODEL, "other")))
    return table(spark, sf, "documents").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    ).select(
        F.floor(F.col("doc_id") / 4).cast("long").alias("video_id"),
        F.get(models, (F.col("doc_id") % 4).cast("int")).alias("model"),
        F.when(F.col("quality") == 1, " Pass").when(F.col("quality") == 0, "fail").alias("pass_fail"),
        "n_chars",
    )


@query(
    "best_result",
    with_ctes(
        """SELECT video_id, arg_min(model, rank) AS model,
  CASE WHEN min(rank) < 2 THEN 'cheaper_candidate_passed' ELSE 'baseline_fallback' END AS model_selection_reason
FROM (SELECT *, CASE model WHEN 'cheap-1' THEN 0 WHEN 'cheap-2' THEN 1 ELSE 2 END AS rank FROM results
  WHERE model = 'gemini-2.5-flash-baseline' OR (model LIKE 'cheap%' AND lower(trim(pass_fail)) = 'pass'))
GROUP BY 1""",
        _RESULTS,
    ),
)
def best_result(spark, sf):
    return cl.best_result(_results(spark, sf), ["cheap-1", "cheap-2"]).select(
        "video_id", "model", "model_selection_reason"
    )


_FALLBACK = """
primary_ AS (SELECT video_id, model, pass_fail, n_chars / 1000.0 AS media_cost, n_chars / 5000.0 AS eval_cost,
    n_chars % 9 AS claim_count, n_chars % 60 AS score FROM results WHERE model = 'cheap-1'),
fallback_ AS (SELECT video_id, model, pass_fail, n_chars / 500.0 AS media_cost, n_chars / 5000.0 AS eval_cost,
    n_chars % 9 AS claim_count FROM results WHERE model = 'cheap-2'),
chosen AS (
  SELECT p.video_id, p.score, CASE WHEN use THEN f.model ELSE p.model END AS model,
    CASE WHEN use THEN f.media_cost ELSE p.media_cost END AS media_cost,
    CASE WHEN use THEN f.eval_cost ELSE p.eval_cost END AS eval_cost,
    coalesce(lower(trim(CASE WHEN use THEN f.pass_fail ELSE p.pass_fail END)) = 'pass', false) AS passed,
    CASE WHEN use THEN f.claim_count ELSE p.claim_count END AS raw_claims
  FROM (SELECT p.*, coalesce(lower(trim(p.pass_fail)), '') <> 'pass' AND p.score >= 30
      AND coalesce(lower(trim(f.pass_fail)), '') = 'pass' AS use
    FROM primary_ p LEFT JOIN fallback_ f USING (video_id)) p LEFT JOIN fallback_ f USING (video_id))
""".strip()


def _fallback(spark, sf) -> DataFrame:
    rows = _results(spark, sf)
    shaped = lambda model, per: rows.where(F.col("model") == model).select(
        "video_id", "model", "pass_fail", (F.col("n_chars") / per).alias("media_cost"),
        (F.col("n_chars") / 5000.0).alias("eval_cost"), (F.col("n_chars") % 9).alias("claim_count"),
        (F.col("n_chars") % 60).alias("score"),
    )
    return cl.fallback_result(shaped("cheap-1", 1000.0), shaped("cheap-2", 500.0).drop("score"))


@query(
    "fallback_result",
    with_ctes(
        """SELECT video_id, model, passed, CASE WHEN passed THEN raw_claims ELSE 0 END AS claim_count,
  round(media_cost, 6) AS media_cost FROM chosen""",
        _RESULTS, _FALLBACK,
    ),
)
def fallback_result(spark, sf):
    return _fallback(spark, sf).select(
        "video_id", "model", "passed", *_long("claim_count"), _r("media_cost")
    )


@query(
    "evaluation_totals",
    with_ctes(
        """SELECT count(*) AS source_count, count(*) FILTER (WHERE passed) AS passed_source_count,
  CAST(sum(CASE WHEN passed THEN raw_claims ELSE 0 END) AS BIGINT) AS claims_retained,
  round(sum(media_cost), 4) AS media_cost, round(sum(eval_cost), 4) AS eval_cost FROM chosen""",
        _RESULTS, _FALLBACK,
    ),
)
def evaluation_totals(spark, sf):
    return cl.evaluation_totals(_fallback(spark, sf)).select(
        "source_count", "passed_source_count", *_long("claims_retained"), _r("media_cost", 4),
        _r("eval_cost", 4),
    )


@query(
    "candidate_grid",
    with_ctes(
        """SELECT video_id, model, n_chars, lower(trim(pass_fail)) AS verdict FROM results
WHERE model LIKE 'cheap%' AND pass_fail IS NOT NULL""",
        _RESULTS,
    ),
)
def candidate_grid(spark, sf):
    rows = _results(spark, sf)
    wanted = rows.select("model").distinct().where(F.startswith("model", F.lit("cheap")))
    evaluations = rows.where("pass_fail IS NOT NULL").select(
        "video_id", "model", F.lower(F.trim("pass_fail")).alias("verdict")
    )
    candidates = rows.select("video_id", "model", "n_chars")
    return cl.candidate_grid(rows.select("video_id").distinct(), wanted, candidates, evaluations).select(
        "video_id", "model", "n_chars", "verdict"
    )


@query(
    "metadata_overlay",
    """SELECT c_custkey, coalesce(s_name, c_name) AS name, coalesce(s_nationkey, c_nationkey) AS nation, c_acctbal
FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = c_custkey""",
)
def metadata_overlay(spark, sf):
    left = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), "c_acctbal"
    )
    right = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
    )
    return cl.overlay(left, right, "c_custkey").select("c_custkey", "name", "nation", "c_acctbal")


# ---------------------------------------------------------------- sources (pages)

SEEDS = ds.Seeds(
    {"example.com": 5, "example.net": 3},
    ["prediction", "analysis", "breakdown", "training", "lift"],
    ["edit", "short"],
    ("alpha", "beta"),
)

SOURCES = r"""
videos AS (
  SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) || CASE page_id % 6
      WHEN 0 THEN ' Alpha vs Beta prediction' WHEN 1 THEN ' alpha training' WHEN 2 THEN ' stage walk edit'
      WHEN 3 THEN ' beta cancelled breakdown' WHEN 4 THEN ' right arm analysis' ELSE ' alpha style clip' END AS title,
    regexp_extract(url, 'https?://([^/]+)', 1) AS channel, '' AS description,
    CASE WHEN page_id % 7 = 0 THEN 'PT' || (page_id % 60) || 'S' WHEN page_id % 11 = 0 THEN 'live'
      ELSE 'PT' || (page_id % 3) || 'H' || (page_id % 50) || 'M' END AS duration,
    CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END AS caption, page_id * 977 % 20000 AS view_count
  FROM pages),
lowered AS (SELECT *, lower(title) || ' ' AS body, lower(channel) AS chan FROM videos),
scored AS (
  SELECT *, CASE WHEN contains(chan, 'example.com') THEN 15 ELSE 0 END
    + CASE WHEN contains(chan, 'example.net') THEN 9 ELSE 0 END
    + 2 * (contains(body, 'prediction')::INT + contains(body, 'analysis')::INT + contains(body, 'breakdown')::INT
      + contains(body, 'training')::INT + contains(body, 'lift')::INT)
    + CASE WHEN contains(body, 'alpha') AND contains(body, 'beta') THEN 10
        WHEN contains(body, 'alpha') OR contains(body, 'beta') THEN 3 ELSE 0 END
    - 4 * (contains(body, 'edit')::INT + contains(body, 'short')::INT)
    + (caption = 'true')::INT + (view_count > 10000)::INT AS score FROM lowered),
ranked_sources AS (SELECT *, row_number() OVER (ORDER BY score DESC, view_count DESC, id) - 1 AS rank FROM scored),
timed AS (
  SELECT *, CASE WHEN NOT regexp_matches(duration, '^PT(\d+H)?(\d+M)?(\d+S)?$') THEN 0 ELSE
      coalesce(TRY_CAST(regexp_extract(duration, '(\d+)H', 1) AS BIGINT), 0) * 3600
      + coalesce(TRY_CAST(regexp_extract(duration, '(\d+)M', 1) AS BIGINT), 0) * 60
      + coalesce(TRY_CAST(regexp_extract(duration, '(\d+)S', 1) AS BIGINT), 0) END AS seconds FROM ranked_sources),
rules AS (
  SELECT *, seconds <= 45 AND (contains(body, 'stage walk') OR contains(body, 'walkout') OR contains(body, 'edit')
      OR contains(body, 'short')) AS is_short,
    contains(body, 'cancelled') OR contains(body, 'canceled') AS is_cancelled,
    contains(body, 'alpha') AND contains(body, 'beta') AS is_direct,
    contains(body, 'alpha style') AND NOT contains(body, 'beta') AS is_style FROM timed),
classified AS (
  SELECT *, is_short OR is_cancelled AS excluded, CASE WHEN is_direct THEN 'direct_or_near_direct'
    WHEN is_style THEN 'style_evidence' WHEN is_cancelled THEN 'exclude_cancellation_context'
    WHEN is_short THEN 'exclude_low_signal_short' ELSE 'review' END AS filter_category FROM rules)
""".strip()


def videos(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    endings = (
        " Alpha vs Beta prediction", " alpha training", " stage walk edit",
        " beta cancelled breakdown", " right arm analysis", " alpha style clip",
    )
    ending = F.get(F.array(*map(F.lit, endings)), (i % 6).cast("int"))
    number = lambda n: (i % n).cast("string")
    duration = (
        F.when(i % 7 == 0, F.concat(F.lit("PT"), number(60), F.lit("S")))
        .when(i % 11 == 0, "live")
        .otherwise(F.concat(F.lit("PT"), number(3), F.lit("H"), number(50), F.lit("M")))
    )
    return table(spark, sf, "pages").select(
        i.alias("id"),
        F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), ending).alias("title"),
        F.regexp_extract("url", "https?://([^/]+)", 1).alias("channel"),
        F.lit("").alias("description"), duration.alias("duration"),
        F.when(i % 2 == 0, "true").otherwise("false").alias("caption"),
        (i * 977 % 20000).alias("view_count"),
    )


def _ranked(spark, sf) -> DataFrame:
    scored = ds.score_sources(videos(spark, sf), SEEDS)
    return ds.rank_sources(stage(scored, "scored"))


@query(
    "source_scores",
    with_ctes(
        """SELECT id, score, CAST(rank AS BIGINT) AS rank FROM ranked_sources""", SOURCES
    ),
)
def source_scores(spark, sf):
    return _ranked(spark, sf).select("id", "score", *_long("rank"))


@query(
    "source_reasons",
    with_ctes(
        """SELECT id, array_to_string(list_filter([
    CASE WHEN contains(chan, 'example.com') THEN 'trusted channel: example.com' END,
    CASE WHEN contains(chan, 'example.net') THEN 'trusted channel: example.net' END,
    CASE WHEN contains(body, 'prediction') THEN 'matched term: prediction' END,
    CASE WHEN contains(body, 'analysis') THEN 'matched term: analysis' END,
    CASE WHEN contains(body, 'breakdown') THEN 'matched term: breakdown' END,
    CASE WHEN contains(body, 'training') THEN 'matched term: training' END,
    CASE WHEN contains(body, 'lift') THEN 'matched term: lift' END,
    CASE WHEN contains(body, 'alpha') AND contains(body, 'beta') THEN 'mentions both targets' END,
    CASE WHEN contains(body, 'alpha') <> contains(body, 'beta') THEN 'mentions one target athlete' END,
    CASE WHEN contains(body, 'edit') THEN 'negative term: edit' END,
    CASE WHEN contains(body, 'short') THEN 'negative term: short' END,
    CASE WHEN caption = 'true' THEN 'caption flag true' END,
    CASE WHEN view_count > 10000 THEN '10k+ views' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM lowered""",
        SOURCES,
    ),
)
def source_reasons(spark, sf):
    return ds.score_sources(videos(spark, sf), SEEDS).select(
        "id", F.array_join("score_reasons", "; ").alias("reasons")
    )


@query(
    "source_filter",
    with_ctes(
        """SELECT id, seconds AS duration_seconds, filter_category, excluded AS exclude_high_confidence,
  coalesce(nullif(array_to_string(list_filter([
    CASE WHEN is_short THEN 'very short stage-walk/edit/short-style video' END,
    CASE WHEN is_cancelled THEN 'cancellation/replacement news' END,
    CASE WHEN is_direct THEN 'mentions both target athletes' END,
    CASE WHEN is_style THEN 'style context, not the direct matchup' END,
    CASE WHEN contains(body, 'predict') OR contains(body, 'analysis') OR contains(body, 'breakdown')
      THEN 'analysis/prediction language' END,
    CASE WHEN contains(body, 'right hand') OR contains(body, 'right arm') THEN 'right-hand/right-arm signal' END,
    CASE WHEN seconds >= 600 THEN 'long-form or match-length source' END],
    lambda x: x IS NOT NULL), '; '), ''), 'ambiguous; keep for review') AS reasons FROM classified""",
        SOURCES,
    ),
)
def source_filter(spark, sf):
    rows = ds.classify_sources(videos(spark, sf), SEEDS.targets, "alpha style")
    return rows.select(
        "id", "duration_seconds", "filter_category", "exclude_high_confidence",
        F.array_join("filter_reasons", "; ").alias("reasons"),
    )


@query(
    "kept_sources",
    with_ctes(
        "SELECT id, CAST(rank AS BIGINT) AS rank FROM classified WHERE NOT excluded ORDER BY rank LIMIT 40",
        SOURCES,
    ),
)
def kept_sources(spark, sf):
    rows = ds.classify_sources(_ranked(spark, sf), SEEDS.targets, "alpha style")
    return ds.kept_sources(rows).select("id", *_long("rank"))


@query(
    "scope_costs",
    with_ctes(
        """SELECT scope, count(*) AS videos, round(sum(seconds) / 3600.0, 6) AS hours,
  round(sum(seconds) / 3600.0 * 0.0303, 6) AS preview_cost, round(sum(seconds) / 3600.0 * 0.147, 6) AS flash_cost,
  round(sum(seconds) / 3600.0 * 0.1285, 6) AS hybrid_cost, round(count(*) * 0.0015::DOUBLE, 6) AS eval_cost_low,
  round(count(*) * 0.0030::DOUBLE, 6) AS eval_cost_high
FROM (SELECT seconds, 'top 20' AS scope FROM classified WHERE rank < 20
  UNION ALL SELECT seconds, 'top 40' FROM classified WHERE rank < 40
  UNION ALL SELECT seconds, 'all' FROM classified
  UNION ALL SELECT seconds, 'kept' FROM classified WHERE NOT excluded) GROUP BY 1""",
        SOURCES,
    ),
)
def scope_costs(spark, sf):
    rows = ds.classify_sources(_ranked(spark, sf), SEEDS.targets, "alpha style")
    costs = ds.scope_costs(rows)
    return costs.select("scope", "videos", *[_r(c) for c in costs.columns[2:]])


@query(
    "interleave",
    """SELECT id, rank, list_ord FROM (SELECT page_id % 50 AS id, min(row(page_id // 7, page_id % 7)) AS t,
    min(page_id) // 7 AS rank, min(page_id) % 7 AS list_ord FROM pages GROUP BY 1)
ORDER BY rank, list_ord LIMIT 30""",
)
def interleave(spark, sf):
    lists = table(spark, sf, "pages").select(
        (F.col("page_id") % 50).alias("id"), (F.col("page_id") % 7).alias("list_ord"),
        F.floor(F.col("page_id") / 7).cast("long").alias("rank"),
    )
    return ds.interleave(lists, 30)


@query(
    "matched_queries",
    """SELECT id, array_to_string(list(query ORDER BY seq), ',') AS matched_queries FROM (
  SELECT page_id % 50 AS id, 'q' || (page_id % 7) AS query, min(page_id) AS seq FROM pages GROUP BY 1, 2)
GROUP BY 1""",
)
def matched_queries(spark, sf):
    rows = table(spark, sf, "pages").select(
        (F.col("page_id") % 50).alias("id"),
        F.concat(F.lit("q"), (F.col("page_id") % 7).cast("string")).alias("query"),
        F.col("page_id").alias("seq"),
    )
    return ds.matched_queries(rows).select("id", F.array_join("matched_queries", ",").alias("matched_queries"))


# ---------------------------------------------------------------- windows (conversations)

WINDOWS = """
talk AS (SELECT conv_id AS source_id, turn AS claim_id, turn * 60 + conv_id % 60 AS seconds, role FROM conversations),
windows AS (SELECT source_id, greatest(seconds - 45, 0) AS start_seconds, seconds + 45 AS end_seconds
  FROM talk WHERE role = 'system' OR claim_id % 4 = 0),
coverage AS (SELECT t.*, EXISTS (SELECT 1 FROM windows w WHERE w.source_id = t.source_id
  AND t.seconds BETWEEN w.start_seconds AND w.end_seconds) AS covered FROM talk t)
""".strip()


def _coverage(spark, sf) -> DataFrame:
    talk = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("claim_id"),
        (F.col("turn") * 60 + F.col("conv_id") % 60).alias("seconds"), "role",
    )
    windows = talk.where("role = 'system' OR claim_id % 4 = 0").select(
        "source_id", F.greatest(F.col("seconds") - 45, F.lit(0)).alias("start_seconds"),
        (F.col("seconds") + 45).alias("end_seconds"),
    )
    return ds.covered_claims(talk, windows)


@query(
    "window_coverage",
    with_ctes("SELECT source_id, claim_id, seconds, covered FROM coverage", WINDOWS),
)
def window_coverage(spark, sf):
    return _coverage(spark, sf).select("source_id", "claim_id", "seconds", "covered")


@query(
    "coverage_counts",
    with_ctes(
        """SELECT source_id, count(*) AS baseline_claims, count(*) FILTER (WHERE covered) AS covered_claims,
  count(*) FILTER (WHERE NOT covered) AS missed_claims FROM coverage GROUP BY 1""",
        WINDOWS,
    ),
)
def coverage_counts(spark, sf):
    return ds.coverage_counts(_coverage(spark, sf))


@query(
    "normalized_windows",
    """SELECT source_id, pos, s AS start_seconds, least(e, s + 420) AS end_seconds FROM (
  SELECT conv_id AS source_id, turn AS pos, turn * 60 AS s, (turn * 130 + conv_id % 700) - 5 AS e FROM conversations
  WHERE turn < 4 AND conv_id % 9 <> 0) WHERE e > s""",
)
def normalized_windows(spark, sf):
    start = text.format_seconds(F.col("turn") * 60)
    end = F.when(
        F.col("conv_id") % 9 != 0,
        text.format_seconds(F.greatest(F.col("turn") * 130 + F.col("conv_id") % 700 - 5, F.lit(0))),
    ).otherwise("soon")
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), start.alias("start"), end.alias("end")
    )
    return ds.normalize_windows(rows).select("source_id", "pos", *_long("start_seconds", "end_seconds"))


# ---------------------------------------------------------------- model cost (documents)


def _usage(spark, sf) -> DataFrame:
    detail = lambda m, c: F.struct(F.lit(m).alias("modality"), c.cast("long").alias("tokenCount"))
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source",
        F.array(
            detail("TEXT", n), detail("VIDEO", n * 2), detail("AUDIO", n * 3), detail("OTHER", n * 50)
        ).alias("details"),
        F.floor(n / 10).cast("long").alias("output"), "n_chars",
    )


@query(
    "token_costs",
    """SELECT lang, count(*) AS calls, round(sum((n_chars * 3 * 0.30 + n_chars * 3 * 1.00 + (n_chars // 10) * 2.50) / 1e6), 8)
  AS media_cost, round(sum((n_chars * 0.05 + (n_chars // 10) * 0.40) / 1e6), 8) AS text_cost
FROM documents GROUP BY 1""",
)
def token_costs(spark, sf):
    return (
        _usage(spark, sf)
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.round(F.sum(ds.media_cost("details", "output")), 8).alias("media_cost"),
            F.round(F.sum(ds.text_cost("n_chars", "output")), 8).alias("text_cost"),
        )
    )


@query(
    "two_stage_cost",
    """SELECT b.source_id, b.claims AS baseline_claims, round(b.cost, 6) AS baseline_cost,
  coalesce(w.calls, 0) AS windows, coalesce(w.claims, 0) AS window_claims,
  round(coalesce(l.cost, 0) + coalesce(w.cost, 0), 6) AS located_cost,
  CAST(coalesce(l.tokens, 0) + coalesce(w.tokens, 0) AS BIGINT) AS located_tokens,
  round(coalesce(l.cost, 0) + coalesce(w.cost, 0) - b.cost, 6) AS cost_delta
FROM (SELECT source AS source_id, sum(n_chars / 1e4) AS cost, CAST(sum(n_chars % 5) AS BIGINT) AS claims FROM documents
    WHERE doc_id % 3 = 0 GROUP BY 1) b
LEFT JOIN (SELECT source AS source_id, sum(n_chars / 1e4) AS cost, sum(n_chars) AS tokens FROM documents
    WHERE doc_id % 3 = 1 GROUP BY 1) l USING (source_id)
LEFT JOIN (SELECT source AS source_id, sum(n_chars / 1e4) AS cost, sum(n_chars) AS tokens, count(*) AS calls,
    CAST(sum(n_chars % 5) AS BIGINT) AS claims FROM documents WHERE doc_id % 3 = 2 GROUP BY 1) w USING (source_id)""",
)
def two_stage_cost(spark, sf):
    calls = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("source_id"), (F.col("n_chars") / 1e4).alias("cost"),
        F.col("n_chars").alias("tokens"), (F.col("n_chars") % 5).alias("claims"),
    )
    part = lambda i: calls.where(F.col("doc_id") % 3 == i).drop("doc_id")
    return ds.two_stage_cost(part(0), part(1), part(2)).select(
        "source_id", "baseline_claims", _r("baseline_cost"), "windows", "window_claims",
        _r("located_cost"), "located_tokens", _r("cost_delta"),
    )


# ---------------------------------------------------------------- mechanisms (lineitem)

ATOMS = """
atoms AS (
  SELECT l_orderkey AS evidence_index, concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS atom_id,
    CASE l_suppkey % 5 WHEN 0 THEN 'Alpha Smith' WHEN 1 THEN 'the beta' WHEN 2 THEN '' ELSE 'Other ' || (l_suppkey % 11) END AS actor,
    CASE l_returnflag WHEN 'A' THEN 'cup' WHEN 'N' THEN 'press' ELSE '' END AS action,
    CASE l_linestatus WHEN 'O' THEN 'outside' ELSE 'inside' END AS lane,
    CASE l_linenumber % 4 WHEN 0 THEN 'pronated' WHEN 1 THEN 'near pad' WHEN 2 THEN 'hooked' ELSE '' END AS position_state,
    l_quantity > 25 AS current_form_usable,
    CASE l_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence
  FROM lineitem),
named AS (
  SELECT *, CASE WHEN contains(lower(actor), 'alpha') THEN 'Alpha' WHEN contains(lower(actor), 'beta') THEN 'Beta'
      WHEN actor = '' THEN 'Unassigned' ELSE actor END AS who,
    CASE WHEN action = '' THEN 'unknown action' ELSE action END AS act FROM atoms),
nodes AS (
  SELECT who AS actor, act AS action, lane, count(DISTINCT evidence_index) AS claim_count,
    count(*) FILTER (WHERE current_form_usable) AS current_usable_count,
    arg_min(confidence, evidence_index) AS confidence, min(row(evidence_index, atom_id)) AS first_seen
  FROM named GROUP BY 1, 2, 3)
""".strip()

TOKENS = {"Alpha": ["alpha", "smith"], "Beta": ["beta"]}


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda c, n, *words: F.get(F.array(*map(F.lit, words)), (F.col(c) % n).cast("int"))
    supplier = F.col("l_suppkey")
    actor = (
        F.when(supplier % 5 == 0, "Alpha Smith").when(supplier % 5 == 1, "the beta")
        .when(supplier % 5 == 2, "")
        .otherwise(F.concat(F.lit("Other "), (supplier % 11).cast("string")))
    )
    none = F.array().cast("array<string>")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("evidence_index"),
        F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("atom_id"),
        actor.alias("actor"),
        F.when(F.col("l_returnflag") == "A", "cup").when(F.col("l_returnflag") == "N", "press").otherwise("").alias("action"),
        F.when(F.col("l_linestatus") == "O", "outside").otherwise("inside").alias("lane"),
        pick("l_linenumber", 4, "pronated", "near pad", "hooked", "").alias("position_state"),
        (F.col("l_quantity") > 25).alias("current_form_usable"),
        pick("l_orderkey", 3, "low", "medium", "high").alias("confidence"),
        none.alias("enables"), none.alias("denies"),
    )


@query(
    "mechanism_nodes",
    with_ctes(
        "SELECT actor, action, lane, claim_count, current_usable_count, confidence FROM nodes", ATOMS
    ),
)
def mechanism_nodes(spark, sf):
    return mech.mechanism_nodes(atoms(spark, sf), TOKENS).drop("first_seen", "atom_count")


@query(
    "node_claims",
    with_ctes("SELECT DISTINCT who AS actor, act AS action, lane, evidence_index FROM named", ATOMS),
)
def node_claims(spark, sf):
    return mech.node_claims(atoms(spark, sf), TOKENS)


@query(
    "move_counts",
    with_ctes(
        """SELECT CASE WHEN contains(lower(actor), 'alpha') THEN 'a' WHEN contains(lower(actor), 'beta') THEN 'b'
  ELSE 'shared' END AS bucket, actor, CASE WHEN action = '' THEN 'unspecified' ELSE action END AS move,
  arg_min(lane, row(evidence_index, atom_id)) AS lane, count(*) AS moves,
  count(DISTINCT evidence_index) AS claim_count FROM atoms GROUP BY 1, 2, 3""",
        ATOMS,
    ),
)
def move_counts(spark, sf):
    return mech.move_counts(atoms(spark, sf), "alpha", "beta").drop("first_seen")


@query(
    "top_k_lanes",
    with_ctes(
        """SELECT side, position, actor, action, lane, claim_count FROM (
  SELECT *, row_number() OVER (PARTITION BY side ORDER BY claim_count DESC, first_seen, action, lane) AS position
  FROM (SELECT *, CASE WHEN actor IN ('Alpha', 'Beta') THEN actor ELSE 'shared' END AS side FROM nodes))
WHERE position <= CASE side WHEN 'Alpha' THEN 4 WHEN 'Beta' THEN 4 ELSE 6 END""",
        ATOMS,
    ),
)
def top_k_lanes(spark, sf):
    nodes = mech.mechanism_nodes(atoms(spark, sf), TOKENS)
    return mech.top_nodes(nodes, {"Alpha": 4, "Beta": 4}, 6).select(
        "side", *_long("position"), "actor", "action", "lane", "claim_count"
    )


@query(
    "common_values",
    with_ctes(
        """SELECT * FROM (SELECT actor, count(*) AS n FROM atoms GROUP BY 1
ORDER BY n DESC, min(row(evidence_index, atom_id)) LIMIT 20)""",
        ATOMS,
    ),
)
def common_values(spark, sf):
    rows = atoms(spark, sf).withColumn("seq", F.struct("evidence_index", "atom_id"))
    return mech.most_common(rows, "actor", "seq")


CONFLICT_RULES = {
    "outside access vs cup": (("alpha smith", ["pronat", "outside"]), ("the beta", ["cup", "hook"])),
    "press vs pad": (("alpha smith", ["press"]), ("the beta", ["pad"])),
    "never": (("alpha smith", ["no such word"]), ("the beta", ["pad"])),
}


@query(
    "conflicts",
    with_ctes(
        """SELECT rule, array_to_string(a, ',') AS side_a_atom_ids, array_to_string(b, ',') AS side_b_atom_ids FROM (
  SELECT rule, list(atom_id ORDER BY r) FILTER (WHERE side = 'a') AS a, list(atom_id ORDER BY r) FILTER (WHERE side = 'b') AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY rule, side ORDER BY evidence_index, atom_id) AS r FROM (
    SELECT 'outside access vs cup' AS rule, 'a' AS side, * FROM atoms WHERE actor = 'Alpha Smith'
      AND (contains(position_state, 'pronat') OR lane = 'outside')
    UNION ALL SELECT 'outside access vs cup', 'b', * FROM atoms WHERE actor = 'the beta'
      AND (action = 'cup' OR contains(position_state, 'hook'))
    UNION ALL SELECT 'press vs pad', 'a', * FROM atoms WHERE actor = 'Alpha Smith' AND action = 'press'
    UNION ALL SELECT 'press vs pad', 'b', * FROM atoms WHERE actor = 'the beta' AND contains(position_state, 'pad')))
  WHERE r <= 12 GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""",
        ATOMS,
    ),
)
def conflicts(spark, sf):
    return mech.conflicts(atoms(spark, sf), CONFLICT_RULES).select(
        "rule", *[F.array_join(f"side_{s}_atom_ids", ",").alias(f"side_{s}_atom_ids") for s in "ab"]
    )


# ---------------------------------------------------------------- summaries and themes


@query(
    "evidence_summary",
    with_ctes(
        """SELECT dossier, count(*) AS claim_count, count(DISTINCT video_id) AS source_count,
  count(*) FILTER (WHERE source_recency = 'current_window') AS current_form_claim_count,
  count(*) FILTER (WHERE source_recency = 'unknown') AS unknown_count,
  count(*) FILTER (WHERE source_recency = 'historical_context') AS historical_count FROM deduped GROUP BY 1""",
        DOC_CLAIMS,
    ),
)
def evidence_summary(spark, sf):
    histogram = lambda k: F.coalesce(F.try_element_at("recency_distribution", F.lit(k)), F.lit(0)).cast("long")
    return mech.evidence_summary(_deduped(spark, sf), ["dossier"]).select(
        "dossier", "claim_count", "source_count", "current_form_claim_count",
        histogram("unknown").alias("unknown_count"),
        histogram("historical_context").alias("historical_count"),
    )


@query(
    "source_counts",
    with_ctes(
        """SELECT dossier, video_id, count(*) AS claim_count, arg_min(source_recency, evidence_index) AS source_recency,
  min(evidence_index) AS first_index FROM deduped GROUP BY 1, 2""",
        DOC_CLAIMS,
    ),
)
def source_counts(spark, sf):
    rows = _deduped(spark, sf).withColumns({"video_title": F.col("video_id"), "channel": F.col("video_id")})
    return mech.source_counts(rows, ["dossier"]).select(
        "dossier", "video_id", "claim_count", "source_recency", *_long("first_index")
    )


@query(
    "hero_claim",
    with_ctes(
        """SELECT dossier, arg_min(evidence_index, (source_recency <> 'current_window')::BIGINT * 1000000000 + evidence_index)
  AS evidence_index FROM deduped GROUP BY 1""",
        DOC_CLAIMS,
    ),
)
def hero_claim(spark, sf):
    rows = _deduped(spark, sf).withColumn("claim", F.col("claim_sha"))
    return mech.hero_claim(rows, ["dossier"]).select("dossier", *_long("evidence_index"))


_DIMENSIONS = """
dims AS (SELECT doc_id, body, kg, contains(body, 'body weight') OR contains(body, 'current weight')
  OR contains(body, 'competing at') AS weighs FROM measured)
""".strip()


@query(
    "dimension_counts",
    with_ctes(
        f"""SELECT count(*) AS dimension_count, count(*) FILTER (WHERE doc_id % 3 = 0) AS mechanics_dimension_count,
  count(*) FILTER (WHERE weighs AND len(kg) > 0) AS measurement_dimension_count,
  count(*) FILTER (WHERE len({_sql_lifts()}) > 0) AS lift_dimension_count FROM dims""",
        _WEIGHTED, _DIMENSIONS,
    ),
)
def dimension_counts(spark, sf):
    rows = cl.with_text_values(_weighted(spark, sf)).select(
        "doc_id", F.col("text_measurements").alias("measurements"), F.col("text_lifts").alias("lifts"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("hook"))).alias("mechanics"),
    )
    return mech.dimension_counts(rows)


@query(
    "high_signal",
    with_ctes(
        f"""SELECT doc_id, total FROM (SELECT doc_id, CASE WHEN weighs THEN len(kg) ELSE 0 END + len({_sql_lifts()}) AS total FROM dims)
ORDER BY doc_id % 5 = 0 DESC, doc_id % 2 = 0 DESC, total DESC, doc_id LIMIT 30""",
        _WEIGHTED, _DIMENSIONS,
    ),
)
def high_signal(spark, sf):
    rows = cl.with_text_values(_weighted(spark, sf)).select(
        F.col("doc_id").alias("evidence_index"), F.col("text_measurements").alias("measurements"),
        F.col("text_lifts").alias("lifts"), F.array().cast("array<string>").alias("mechanics"),
        F.when(F.col("doc_id") % 5 == 0, "low").otherwise("high").alias("noise_risk"),
        F.when(F.col("doc_id") % 2 == 0, "high").otherwise("low").alias("dimension_confidence"),
    )
    return cl.high_signal(rows).select(
        F.col("evidence_index").alias("doc_id"),
        (F.size("measurements") + F.size("lifts")).cast("long").alias("total"),
    )


THEMES = """
themes AS (
  SELECT conv_id AS dossier_id, turn AS pos, conv_id || '-' || turn AS theme_id, text AS label,
    CASE conv_id % 3 WHEN 0 THEN 'alpha ' WHEN 1 THEN 'Beta ' ELSE '' END AS lead, text, conv_id, turn FROM conversations)
""".strip()


def _themes(spark, sf) -> DataFrame:
    c = F.col("conv_id")
    lead = F.when(c % 3 == 0, "alpha ").when(c % 3 == 1, "Beta ").otherwise("")
    ident = F.concat_ws("-", c.cast("string"), F.col("turn").cast("string"))
    return table(spark, sf, "conversations").select(
        c.alias("dossier_id"), F.col("turn").alias("pos"), ident.alias("theme_id"),
        F.concat(lead, "text").alias("label"),
        F.col("text").alias("match_relevance"),
        F.when(F.col("turn") % 2 == 0, F.lit("people assume")).alias("challenged_assumption"),
        F.col("text").alias("why_this_theme_emerged"),
        (F.col("turn") % 5 + 1).alias("claim_count"),
    )


@query(
    "theme_fronts",
    with_ctes(
        """SELECT dossier_id, theme_id, lpad(CAST(pos + 1 AS VARCHAR), 2, '0') AS ordinal,
  substr(replace(upper(lead || label), 'ẞ', 'SS'), 1, 32) AS label, sha256(split_part(text, '.', 1) || '?') AS question_sha,
  sha256(CASE WHEN turn % 2 = 0 THEN 'people assume' ELSE split_part(text, '.', 1) END) AS take_sha,
  CASE WHEN contains(lower(lead || label), 'alpha') THEN 'a' WHEN contains(lower(lead || label), 'beta') THEN 'b'
    ELSE 'even' END AS leans FROM themes""",
        THEMES,
    ),
)
def theme_fronts(spark, sf):
    return mech.theme_fronts(_themes(spark, sf), "alpha", "beta").select(
        "dossier_id", "theme_id", "ordinal", "label", F.sha2("question", 256).alias("question_sha"),
        F.sha2("popular_take", 256).alias("take_sha"), "leans",
    )


@query(
    "front_verdict",
    with_ctes(
        """SELECT dossier_id, fronts_a, fronts_b, fronts_even, sa AS share_a, sb AS share_b, 100 - sa - sb AS share_even FROM (
  SELECT dossier_id, count(*) FILTER (WHERE leans = 'a') AS fronts_a, count(*) FILTER (WHERE leans = 'b') AS fronts_b,
    count(*) FILTER (WHERE leans = 'even') AS fronts_even,
    CAST(floor(coalesce(sum(n) FILTER (WHERE leans = 'a'), 0) / greatest(1, sum(n)) * 100 + 0.5) AS BIGINT) AS sa,
    CAST(floor(coalesce(sum(n) FILTER (WHERE leans = 'b'), 0) / greatest(1, sum(n)) * 100 + 0.5) AS BIGINT) AS sb
  FROM (SELECT dossier_id, turn % 5 + 1 AS n, CASE WHEN contains(lower(lead || label), 'alpha') THEN 'a'
      WHEN contains(lower(lead || label), 'beta') THEN 'b' ELSE 'even' END AS leans
    FROM (SELECT * REPLACE (dossier_id % 10 AS dossier_id) FROM themes)) GROUP BY 1)""",
        THEMES,
    ),
)
def front_verdict(spark, sf):
    fronts = mech.theme_fronts(_themes(spark, sf), "alpha", "beta").withColumn(
        "dossier_id", F.col("dossier_id") % 10
    )
    return mech.front_verdict(fronts)


@query(
    "theme_claims",
    """SELECT theme_id, position, evidence_index, n_chars FROM (
  SELECT theme_id, evidence_index, n_chars, row_number() OVER (PARTITION BY theme_id ORDER BY pos) AS position FROM (
    SELECT conv_id || '-' || turn AS theme_id, i AS pos, (conv_id * 131 + turn * 17 + i * 290) % (SELECT max(doc_id) + 1 FROM documents) AS evidence_index
    FROM conversations, range(0, 6) t(i)) JOIN documents ON doc_id = evidence_index) WHERE position <= 3""",
)
def theme_claims(spark, sf):
    base = F.col("conv_id") * 131 + F.col("turn") * 17
    documents = table(spark, sf, "documents").agg(F.max("doc_id") + 1).first()[0]
    themes = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("theme_id"),
        F.array(*[(base + i * 290) % documents for i in range(6)]).alias("evidence_refs"),
    )
    claims = table(spark, sf, "documents").select(F.col("doc_id").alias("evidence_index"), "n_chars")
    return mech.theme_claims(themes, claims, 3).select(
        "theme_id", *_long("position"), "evidence_index", "n_chars"
    )


@query(
    "summary_refs",
    """SELECT conv_id || '-' || turn AS theme_id, 0::BIGINT AS pos, conv_id AS evidence_index FROM conversations
UNION ALL SELECT conv_id || '-' || turn, 1, turn * 7 FROM conversations""",
)
def summary_refs(spark, sf):
    summary = F.concat(
        F.lit("claims "), F.col("conv_id").cast("string"), F.lit(" and "),
        (F.col("turn") * 7).cast("string"), F.lit(", not x9y."),
    )
    rows = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("theme_id"),
        summary.alias("summary"),
    )
    return cl.refs_from_summary(rows).select("theme_id", *_long("pos"), "evidence_index")


@query(
    "stale_refs",
    with_ctes(
        """SELECT doc_id, source_recency = 'current_window' AND doc_id % 2 = 0 AS supports_current_form,
  CASE WHEN source_recency <> 'current_window' AND doc_id % 3 <> 0 THEN 'Source is outside the current-form window.'
    WHEN doc_id % 3 = 0 THEN 'own caveat' ELSE '' END AS caveat FROM recent""",
        DOC_CLAIMS,
    ),
)
def stale_refs(spark, sf):
    claims = _recent(doc_claims(spark, sf)).withColumn("evidence_index", F.col("doc_id"))
    refs = claims.select(
        "evidence_index", (F.col("doc_id") % 2 == 0).alias("supports_current_form"),
        F.when(F.col("doc_id") % 3 == 0, "own caveat").otherwise("").alias("caveat"),
    )
    return cl.enforce_recency_on_refs(refs, claims).select(
        F.col("evidence_index").alias("doc_id"), "supports_current_form", "caveat"
    )


@query(
    "classified_recency",
    with_ctes(
        """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'strength' WHEN 2 THEN 'style' ELSE 'form' END AS claim_type,
  CASE WHEN source_recency <> 'current_window' AND doc_id % 2 = 0 THEN 'old_context'
    WHEN doc_id % 2 = 0 THEN 'current' ELSE 'recent' END AS recency,
  source_recency = 'current_window' AND doc_id % 5 <> 0 AS current_form_signal FROM recent""",
        DOC_CLAIMS,
    ),
)
def classified_recency(spark, sf):
    claims = _recent(doc_claims(spark, sf)).withColumn("evidence_index", F.col("doc_id"))
    words = F.array(*map(F.lit, ("Analysis", " physical", "technical", "form")))
    rows = claims.select(
        "evidence_index", F.get(words, (F.col("doc_id") % 4).cast("int")).alias("claim_type"),
        F.when(F.col("doc_id") % 2 == 0, "current").otherwise("recent").alias("recency"),
        (F.col("doc_id") % 5 != 0).alias("current_form_signal"),
    )
    return cl.classify_recency(rows, claims).select(
        F.col("evidence_index").alias("doc_id"), "claim_type", "recency", "current_form_signal"
    )


@query(
    "attached_atoms",
    with_ctes(
        """SELECT o_orderkey AS evidence_index, atom_id, o_orderstatus AS kind FROM orders
LEFT JOIN (SELECT * FROM atoms WHERE current_form_usable) ON evidence_index = o_orderkey""",
        ATOMS,
    ),
)
def attached_atoms(spark, sf):
    orders = table(spark, sf, "orders")
    claims = orders.select(F.col("o_orderkey").alias("evidence_index"))
    dimensions = orders.select(
        F.col("o_orderkey").alias("evidence_index"), F.col("o_orderstatus").alias("kind")
    )
    usable = atoms(spark, sf).where("current_form_usable").select("evidence_index", "atom_id")
    return mech.attach(claims, dimensions, usable).select("evidence_index", "atom_id", "kind")
