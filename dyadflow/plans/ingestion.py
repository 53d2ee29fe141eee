"""Registered queries of the ingestion track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions import text, vocab
from dyadflow.operators import claims as cl
from dyadflow.operators import validation, writes
from dyadflow.operators.keys import resolve_natural_keys
from dyadflow.operators.loading import canonical_rows
from dyadflow.plans import fixtures as fx
from dyadflow.plans.fixtures import DYADS, table, with_ctes
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


# ---------------------------------------------------------------- result rows with mistakes in them

RAW = """
raw_rows AS (
  SELECT match_id AS seq, 'e' || event_id AS event_slug, 'Event ' || event_id AS event_name,
    CASE WHEN match_id % 89 = 0 THEN ' ' ELSE 'P' || (event_id % 3) END AS promoter,
    CASE WHEN match_id % 113 = 0 THEN 'soon' ELSE strftime(held_on, '%Y-%m-%d') END AS event_date,
    CASE WHEN match_id % 97 = 0 THEN 'both' ELSE arm END AS arm, weight_class,
    'Athlete ' || athlete_a_id AS athlete_a, 'Athlete ' || athlete_b_id AS athlete_b,
    CASE WHEN match_id % 101 = 0 THEN 'three' WHEN status <> 'completed' AND match_id % 2 = 0 THEN ''
      ELSE CAST(score_a AS VARCHAR) END AS score_a,
    CASE WHEN status <> 'completed' AND match_id % 2 = 0 THEN ''
      WHEN match_id % 107 = 0 THEN CAST(score_a AS VARCHAR) ELSE CAST(score_b AS VARCHAR) END AS score_b,
    CASE WHEN match_id % 103 = 0 THEN 'cancelled' ELSE status END AS status,
    CASE WHEN match_id % 4 = 0 THEN 'v' || match_id ELSE '' END AS video_id,
    CASE WHEN match_id % 5 = 0 THEN '' WHEN match_id % 109 = 0 THEN '1440'
      ELSE CAST(match_id % 37 + 1 AS VARCHAR) END AS bout
  FROM dyads),
typed AS (
  SELECT *, TRY_CAST(score_a AS INTEGER) AS sa, TRY_CAST(score_b AS INTEGER) AS sb,
    coalesce(TRY_CAST(bout AS INTEGER), 0) AS bt, TRY_CAST(event_date AS DATE) AS day,
    score_a = 'three' AS unreadable FROM raw_rows),
ruled AS (
  SELECT *, list_sort(list_filter([
    CASE WHEN trim(promoter) = '' THEN 'missing promoter' END,
    CASE WHEN day IS NULL THEN 'invalid event_date' END,
    CASE WHEN bt > 1439 THEN 'bout must be a minute from 1 through 1439' END,
    CASE WHEN unreadable THEN 'non-numeric score in score_a' END,
    CASE WHEN arm = 'both' THEN 'unrecognized arm both' END,
    CASE WHEN status = 'cancelled' THEN 'unrecognized status cancelled' END,
    CASE WHEN status <> 'completed' AND NOT unreadable AND (score_a <> '' OR score_b <> '')
      THEN 'scores are allowed only for completed matches' END,
    CASE WHEN status = 'completed' AND (unreadable OR sa IS NULL OR sb IS NULL OR sa = sb)
      THEN 'completed match requires unequal numeric scores' END], lambda x: x IS NOT NULL)) AS found,
    concat_ws('|', event_slug, arm, least(lower(athlete_a), lower(athlete_b)),
      greatest(lower(athlete_a), lower(athlete_b)), event_date) AS meeting FROM typed),
meetings AS (
  SELECT meeting, min(bt) = 0 OR count(DISTINCT bt) < count(*) AS clash FROM ruled WHERE len(found) = 0
  GROUP BY 1 HAVING count(*) > 1),
checked AS (
  SELECT r.*, CASE WHEN len(found) = 0 AND coalesce(clash, false)
      THEN ['repeated same-day match requires distinct bout values'] ELSE found END AS problems,
    CASE WHEN len(found) = 0 AND clash IS NOT NULL THEN day::TIMESTAMP + to_minutes(bt) ELSE day::TIMESTAMP END AS starts
  FROM ruled r LEFT JOIN meetings USING (meeting)),
good AS (SELECT * FROM checked WHERE len(problems) = 0)
""".strip()


def raw_results(spark: SparkSession, sf: str) -> DataFrame:
    m, e = F.col("match_id"), F.col("event_id")
    s = lambda c: F.col(c).cast("string")
    unscored = (F.col("status") != "completed") & (m % 2 == 0)
    return fx.dyads(spark, sf).select(
        m.alias("seq"),
        F.concat(F.lit("e"), s("event_id")).alias("event_slug"),
        F.concat(F.lit("Event "), s("event_id")).alias("event_name"),
        F.when(m % 89 == 0, " ").otherwise(F.concat(F.lit("P"), (e % 3).cast("string"))).alias("promoter"),
        F.when(m % 113 == 0, "soon").otherwise(F.date_format("held_on", "yyyy-MM-dd")).alias("event_date"),
        F.when(m % 97 == 0, "both").otherwise(F.col("arm")).alias("arm"),
        "weight_class",
        F.concat(F.lit("Athlete "), s("athlete_a_id")).alias("athlete_a"),
        F.concat(F.lit("Athlete "), s("athlete_b_id")).alias("athlete_b"),
        F.when(m % 101 == 0, "three").when(unscored, "").otherwise(s("score_a")).alias("score_a"),
        F.when(unscored, "").when(m % 107 == 0, s("score_a")).otherwise(s("score_b")).alias("score_b"),
        F.when(m % 103 == 0, "cancelled").otherwise(F.col("status")).alias("status"),
        F.when(m % 4 == 0, F.concat(F.lit("v"), s("match_id"))).otherwise("").alias("video_id"),
        F.when(m % 5 == 0, "").when(m % 109 == 0, "1440").otherwise((m % 37 + 1).cast("string")).alias("bout"),
    )


def _checked(spark, sf) -> DataFrame:
    # the rows stand for files that landed: written once, then read by every rule
    return validation.validate_results(stage(raw_results(spark, sf), "raw-results"))


@query(
    "results_validated",
    with_ctes(
        """SELECT seq, event_slug, arm, athlete_a, athlete_b, sa AS score_a, sb AS score_b, status,
  strftime(starts, '%Y-%m-%d %H:%M') AS scheduled_at FROM good""",
        DYADS, RAW,
    ),
)
def results_validated(spark, sf):
    return validation.accepted(_checked(spark, sf)).select(
        "seq", "event_slug", "arm", "athlete_a", "athlete_b", "score_a", "score_b", "status",
        F.date_format("scheduled_at", "yyyy-MM-dd HH:mm").alias("scheduled_at"),
    )


@query(
    "results_quarantine",
    with_ctes(
        "SELECT seq, array_to_string(problems, '; ') AS problems FROM checked WHERE len(problems) > 0",
        DYADS, RAW,
    ),
)
def results_quarantine(spark, sf):
    return validation.quarantine(_checked(spark, sf)).select(
        "seq", F.array_join("problems", "; ").alias("problems")
    )


@query(
    "batch_outcomes",
    with_ctes(
        """SELECT event_slug, count(*) AS selected, count(*) FILTER (WHERE len(problems) = 0) AS completed,
  count(*) FILTER (WHERE len(problems) > 0) AS failed FROM checked GROUP BY 1""",
        DYADS, RAW,
    ),
)
def batch_outcomes(spark, sf):
    return validation.outcome_counts(_checked(spark, sf), ["event_slug"])


@query(
    "whole_file_accept",
    with_ctes(
        """SELECT seq, event_slug || ':' || seq % 97 AS batch_key FROM checked
WHERE event_slug || ':' || seq % 97 NOT IN (SELECT event_slug || ':' || seq % 97 FROM checked WHERE len(problems) > 0)""",
        DYADS, RAW,
    ),
)
def whole_file_accept(spark, sf):
    file_key = F.concat_ws(":", "event_slug", (F.col("seq") % 97).cast("string"))
    rows = _checked(spark, sf).withColumn("batch_key", file_key)
    return validation.accepted_files(rows, "batch_key").select("seq", "batch_key")


KEYS = """
based AS (SELECT *, concat_ws(':', event_slug, least(replace(lower(athlete_a), ' ', '-'), replace(lower(athlete_b), ' ', '-')),
    greatest(replace(lower(athlete_a), ' ', '-'), replace(lower(athlete_b), ' ', '-')), arm) AS base_key FROM good),
moments AS (SELECT base_key, starts, min(seq) AS first_seq FROM based GROUP BY 1, 2),
stored AS (SELECT base_key, base_key AS natural_key, min(starts) AS starts FROM moments
  WHERE base_key LIKE '%:right' GROUP BY 1),
keyed AS (
  SELECT m.base_key, m.starts, s.natural_key AS stored_key,
    row_number() OVER (PARTITION BY m.base_key, s.natural_key IS NULL ORDER BY first_seq)
      + CASE WHEN m.base_key LIKE '%:right' THEN 1 ELSE 0 END AS number
  FROM moments m LEFT JOIN stored s ON s.base_key = m.base_key AND s.starts = m.starts),
resolved AS (
  SELECT b.*, coalesce(stored_key, CASE WHEN number = 1 THEN k.base_key ELSE k.base_key || ':' || number END) AS natural_key
  FROM based b JOIN keyed k ON k.base_key = b.base_key AND k.starts = b.starts)
""".strip()


def _existing(rows: DataFrame) -> DataFrame:
    """What an earlier load would have stored: the first right-arm meeting of each pair and event."""
    return (
        rows.where("arm = 'right'")
        .groupBy("base_key")
        .agg(F.min("scheduled_at").alias("scheduled_at"))
        .withColumn("natural_key", F.col("base_key"))
    )


def _based(spark, sf) -> DataFrame:
    good = validation.accepted(_checked(spark, sf))
    return stage(
        good.withColumn("base_key", text.base_natural_key("event_slug", "athlete_a", "athlete_b", "arm")),
        "results",
    )


@query("rematch_keys", with_ctes("SELECT seq, base_key, natural_key FROM resolved", DYADS, RAW, KEYS))
def rematch_keys(spark, sf):
    rows = _based(spark, sf)
    return resolve_natural_keys(rows, _existing(rows)).select("seq", "base_key", "natural_key")


@query(
    "canonical_competitors",
    with_ctes(
        """SELECT natural_key, athlete_a AS canonical_name, sa AS score, CASE WHEN status = 'no_contest' THEN 'no_contest'
  WHEN sa > sb THEN 'win' ELSE 'loss' END AS result FROM resolved
UNION ALL SELECT natural_key, athlete_b, sb, CASE WHEN status = 'no_contest' THEN 'no_contest'
  WHEN sb > sa THEN 'win' ELSE 'loss' END FROM resolved""",
        DYADS, RAW, KEYS,
    ),
)
def canonical_competitors(spark, sf):
    rows = _based(spark, sf)
    loaded = canonical_rows(rows.drop("base_key"), _existing(rows))
    matches = writes.latest(loaded.matches, ["natural_key"], "seq").select("match_id", "natural_key")
    competitors = writes.latest(loaded.competitors, ["match_id", "athlete_id"], "seq")
    return competitors.join(matches, "match_id").select(
        "natural_key", "canonical_name", "score", "result"
    )


@query(
    "match_competitor_names",
    with_ctes(
        """SELECT match_id, least(a.s_name, b.s_name) AS name_1, greatest(a.s_name, b.s_name) AS name_2
FROM dyads JOIN supplier a ON a.s_suppkey = athlete_a_id JOIN supplier b ON b.s_suppkey = athlete_b_id""",
        DYADS,
    ),
)
def match_competitor_names(spark, sf):
    from dyadflow.operators.dyads import competitor_names

    athletes = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("athlete_id"), F.col("s_name").alias("canonical_name")
    )
    competitors = fx.dyads(spark, sf).select(
        "match_id", F.explode(F.array("athlete_a_id", "athlete_b_id")).alias("athlete_id")
    )
    return competitor_names(competitors, athletes)


@query(
    "search_plan",
    with_ctes(
        """SELECT match_id, i AS pos, [a || ' ' || b, a || ' ' || b || ' ' || arm || ' arm', a || ' ' || b || ' prediction',
  a || ' ' || b || ' analysis', a || ' interview ' || arm || ' arm', b || ' interview ' || arm || ' arm',
  a || ' training ' || arm || ' arm', b || ' training ' || arm || ' arm', a || ' injury recovery',
  b || ' injury recovery'][i + 1] AS phrase
FROM (SELECT match_id, arm, 'Athlete ' || athlete_a_id AS a, 'Athlete ' || athlete_b_id AS b FROM dyads), range(0, 10) t(i)""",
        DYADS,
    ),
)
def search_plan(spark, sf):
    name = lambda c: F.concat(F.lit("Athlete "), F.col(c).cast("string"))
    return fx.dyads(spark, sf).select(
        "match_id",
        F.posexplode(text.search_plan(name("athlete_a_id"), name("athlete_b_id"), "arm")).alias("pos", "phrase"),
    ).withColumn("pos", F.col("pos").cast("long"))


# ---------------------------------------------------------------- submissions


SUBMISSIONS = """
submitted AS (
  SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 31 = 0 THEN 'v0' ELSE 'result-submission-v1' END AS version,
    CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 'b' || o_orderkey END AS batch_key,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'scheduled' ELSE 'dq' END AS status,
    'Customer ' || o_custkey AS n1, CASE WHEN o_orderkey % 41 = 0 THEN 'Customer ' || o_custkey ELSE 'Clerk ' || o_orderkey END AS n2,
    CASE WHEN o_orderkey % 3 = 0 THEN 'win' ELSE 'loss' END AS r1,
    CASE WHEN o_orderkey % 43 = 0 THEN 'draw' WHEN o_orderkey % 3 = 0 THEN 'loss' ELSE 'win' END AS r2 FROM orders)
""".strip()


@query(
    "submission_rules",
    with_ctes(
        """SELECT o_orderkey, array_to_string(list_sort(list_filter([
    CASE WHEN version = 'v0' THEN 'unsupported result submission schema version' END,
    CASE WHEN batch_key = '' THEN 'result submission requires a batch key' END,
    CASE WHEN n1 = n2 THEN 'duplicate competitor name' END,
    CASE WHEN r2 = 'draw' THEN 'competitor has an unrecognized result' END,
    CASE WHEN status = 'completed' AND o_orderkey % 47 = 0 THEN 'competitor requires a score for a completed match' END,
    CASE WHEN status = 'completed' AND (r1 = 'win')::INT + (r2 = 'win')::INT <> 1
      THEN 'a completed match requires exactly one winner' END,
    CASE WHEN o_orderkey % 53 = 0 THEN 'video requires an id' END], lambda x: x IS NOT NULL)), '; ') AS problems
FROM submitted""",
        SUBMISSIONS,
    ),
)
def submission_rules(spark, sf):
    k = F.col("o_orderkey")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    first = F.struct(
        tag("Customer ", "o_custkey").alias("athlete_name"),
        F.when(k % 47 != 0, 3).alias("score"),
        F.when(k % 3 == 0, "win").otherwise("loss").alias("result"),
    )
    second = F.struct(
        F.when(k % 41 == 0, tag("Customer ", "o_custkey")).otherwise(tag("Clerk ", "o_orderkey")).alias("athlete_name"),
        F.lit(2).alias("score"),
        F.when(k % 43 == 0, "draw").when(k % 3 == 0, "loss").otherwise("win").alias("result"),
    )
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 31 == 0, "v0").otherwise(vocab.RESULT_SCHEMA_VERSION).alias("schema_version"),
        F.when(k % 37 == 0, "").otherwise(tag("b", "o_orderkey")).alias("batch_key"),
        F.struct(
            F.lit("slug").alias("slug"), F.lit("p").alias("promoter"), F.lit("n").alias("name"),
            F.to_date("o_orderdate").alias("held_on"),
        ).alias("event"),
        F.lit("left").alias("arm"), F.lit("open").alias("weight_class"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "scheduled").otherwise("dq").alias("status"),
        F.col("o_orderdate").alias("scheduled_at"),
        F.array(first, second).alias("competitors"),
        F.array(F.when(k % 53 == 0, " ").otherwise("v")).alias("video_ids"),
    )
    return validation.result_submission_problems(rows).select(
        "o_orderkey", F.array_join("problems", "; ").alias("problems")
    )


@query(
    "evidence_references",
    """WITH batches AS (SELECT o_orderkey % 500 AS b, o_orderkey AS k, o_orderstatus AS s, o_orderdate AS d FROM orders),
src AS (SELECT b, k % 7 AS key FROM batches WHERE k % 11 <> 0),
ext AS (SELECT b, k, k % 5 AS key, k % 7 AS source_key, s, d FROM batches),
last AS (SELECT * FROM ext QUALIFY row_number() OVER (PARTITION BY b, key ORDER BY d DESC, source_key DESC, s DESC) = 1)
SELECT DISTINCT * FROM (
  SELECT 'b' || b AS batch_key, 'duplicate source key: s' || key AS problem FROM src GROUP BY b, key HAVING count(*) > 1
  UNION ALL SELECT 'b' || b, 'duplicate extraction key: x' || key FROM ext GROUP BY b, key HAVING count(*) > 1
  UNION ALL SELECT 'b' || b, 'extraction references unknown source: s' || source_key FROM ext e
    WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.b = e.b AND src.key = e.source_key)
  UNION ALL SELECT 'b' || b, 'extraction status must be completed or failed' FROM ext WHERE s = 'P'
  UNION ALL SELECT 'b' || b, 'failed extraction requires an error message' FROM ext WHERE s = 'O' AND k % 2 = 0
  UNION ALL SELECT 'b' || b, 'completed extraction cannot contain an error message' FROM ext WHERE s = 'F' AND k % 2 = 1
  UNION ALL SELECT 'b' || b, 'claim references unknown source: s' || (k % 9) FROM batches c
    WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.b = c.b AND src.key = c.k % 9)
  UNION ALL SELECT 'b' || b, 'claim requires at least one subject' FROM batches WHERE k % 13 = 0
  UNION ALL SELECT 'b' || b, 'claim references unknown extraction: x' || (k % 6) FROM batches c WHERE k % 3 = 0
    AND NOT EXISTS (SELECT 1 FROM ext WHERE ext.b = c.b AND ext.key = c.k % 6)
  UNION ALL SELECT 'b' || c.b, 'claim extraction must be completed and reference the same source'
    FROM batches c JOIN last l ON l.b = c.b AND l.key = c.k % 6
    WHERE c.k % 3 = 0 AND (l.s <> 'F' OR l.source_key <> c.k % 9))""",
)
def evidence_references(spark, sf):
    k = F.col("o_orderkey")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    base = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", tag("b", k % 500).alias("batch_key")
    )
    submissions = base.select(
        "batch_key", F.lit(vocab.EVIDENCE_SCHEMA_VERSION).alias("schema_version"),
        F.lit("m").alias("match_natural_key"),
    ).distinct()
    one = F.lit("1")
    sources = base.where(k % 11 != 0).select(
        "batch_key", tag("s", k % 7).alias("key"), one.alias("source_type"),
        one.alias("external_id"), one.alias("url"),
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    )
    extractions = base.select(
        "batch_key", tag("x", k % 5).alias("key"), tag("s", k % 7).alias("source_key"),
        one.alias("provider"), one.alias("model"), one.alias("prompt_version"),
        F.col("o_orderdate").alias("extracted_at"), status.alias("status"),
        F.when(k % 2 == 1, "broken").alias("error_message"),
    )
    claims = base.select(
        "batch_key", tag("s", k % 9).alias("source_key"), one.alias("text"),
        F.col("o_orderdate").alias("extracted_at"),
        F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(one)).alias("subject_names"),
        F.when(k % 3 == 0, tag("x", k % 6)).otherwise("").alias("extraction_key"),
    )
    return validation.evidence_problems(submissions, sources, extractions, claims)


@query(
    "claim_subject_rules",
    with_ctes(
        """SELECT match_id, athlete_a_id + 1 AS name FROM dyads WHERE match_id % 3 = 0 AND athlete_a_id + 1 <> athlete_b_id""",
        DYADS,
    ),
)
def claim_subject_rules(spark, sf):
    rows = fx.dyads(spark, sf)
    competitors = rows.select(
        "match_id", F.explode(F.array("athlete_a_id", "athlete_b_id")).alias("name")
    )
    claimed = F.when(
        F.col("match_id") % 3 == 0, F.array("athlete_a_id", F.col("athlete_a_id") + 1)
    ).otherwise(F.array("athlete_b_id"))
    claims = rows.select("match_id", F.col("match_id").alias("claim_id"), claimed.alias("subject_names"))
    return validation.subject_problems(claims, competitors).select("match_id", "name")


@query(
    "extraction_rules",
    """SELECT event_id, array_to_string(list_sort(list_filter([
    CASE WHEN event_id % 17 = 0 THEN 'claim requires text and relevance' END,
    CASE WHEN event_id % 900 - 5 < 0 OR event_id % 900 - 5 > 800 THEN 'claim timestamp is outside video duration' END,
    CASE WHEN event_type = 'purchase' THEN 'claim has unknown confidence' END,
    CASE WHEN event_id % 19 = 0 THEN 'claim has unknown claim type' END,
    CASE WHEN user_id % 5 = 4 THEN 'claim references unknown subject' END], lambda x: x IS NOT NULL)), '; ') AS problems
FROM events""",
)
def extraction_rules(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.col("props").alias("text"),
        F.when(i % 17 != 0, "r").alias("relevance"),
        (i % 900 - 5).alias("timestamp_seconds"), F.lit(800).alias("duration_seconds"),
        F.when(F.col("event_type") == "purchase", "certain").otherwise("high").alias("confidence"),
        F.when(i % 19 == 0, "rumour").otherwise("form").alias("claim_type"),
        F.array((F.col("user_id") % 5).cast("string")).alias("subject_names"),
        F.array(*map(F.lit, "0123")).alias("competitor_names"),
    )
    return validation.extraction_problems(rows).select(
        "event_id", F.array_join("problems", "; ").alias("problems")
    )


@query(
    "widened_durations",
    """SELECT conv_id, greatest(any_value(conv_id) % 400, CAST(ceil(max(turn * 61.5)) AS BIGINT)) AS duration_seconds
FROM conversations GROUP BY 1""",
)
def widened_durations(spark, sf):
    rows = table(spark, sf, "conversations")
    videos = rows.select(
        F.col("conv_id").alias("video_id"), (F.col("conv_id") % 400).alias("duration_seconds")
    ).distinct()
    segments = rows.select(
        F.col("conv_id").alias("video_id"), (F.col("turn") * 61.5).alias("end_seconds")
    )
    return validation.widen_durations(videos, segments).select(
        F.col("video_id").alias("conv_id"), "duration_seconds"
    )


_GATE = """
syn AS (SELECT DISTINCT conv_id % 40 AS d FROM conversations),
clu AS (SELECT conv_id % 40 AS d, conv_id AS c, turn AS e FROM conversations),
cas AS (SELECT conv_id % 40 AS d, role FROM conversations),
cls AS (SELECT conv_id % 40 AS d, turn AS e, turn % 4 = 0 AS signal, turn % 8 = 0 AS allowed FROM conversations WHERE turn % 2 = 0)
""".strip()


@query(
    "bundle_gate",
    with_ctes(
        """SELECT DISTINCT * FROM (
  SELECT d AS dossier_id, 'blank fields' AS problem FROM syn WHERE d % 7 = 0
  UNION ALL SELECT d, 'fewer than 3 evidence clusters' FROM clu GROUP BY d HAVING count(DISTINCT c) < 3
  UNION ALL SELECT d, 'case points are too sparse' FROM cas GROUP BY d
    HAVING count(*) FILTER (WHERE role = 'user') < 3 OR count(*) FILTER (WHERE role = 'assistant') < 3
  UNION ALL SELECT d, 'clusters without classified evidence' FROM clu x GROUP BY d, c
    HAVING count(*) FILTER (WHERE e IN (SELECT e FROM cls WHERE cls.d = x.d)) = 0
  UNION ALL SELECT d, 'stale evidence marked current form' FROM cls WHERE signal AND NOT allowed)""",
        _GATE,
    ),
)
def bundle_gate(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("dossier_id", F.col("conv_id") % 40)
    full = F.when(F.col("dossier_id") % 7 == 0, " ").otherwise("text")
    syntheses = rows.select("dossier_id").distinct().select(
        "dossier_id", full.alias("popular_take"),
        *[F.lit("text").alias(c) for c in ("counter_case", "what_community_might_be_missing", "key_question")],
    )
    clusters = rows.select("dossier_id", F.col("conv_id").alias("cluster_id"), F.col("turn").alias("evidence_index"))
    side = F.when(F.col("role") == "user", "a").when(F.col("role") == "assistant", "b")
    cases = rows.select("dossier_id", side.alias("side"))
    classified = rows.where("turn % 2 = 0").select(
        "dossier_id", F.col("turn").alias("evidence_index"),
        (F.col("turn") % 4 == 0).alias("current_form_signal"),
        (F.col("turn") % 8 == 0).alias("current_form_allowed"),
    )
    return validation.bundle_gate(syntheses, clusters, cases, classified)


# ---------------------------------------------------------------- upserts


@query(
    "upsert_latest",
    """SELECT c_custkey AS id, c_mktsegment AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FROM orders GROUP BY 1""",
)
def upsert_latest(spark, sf):
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value")
    )
    updates = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq")
    )
    return writes.upsert(base, updates, ["id"], "seq")


@query(
    "insert_ignore",
    """SELECT o_custkey AS match_id, o_orderpriority AS video_id, min(o_orderkey % 2) AS origin FROM orders
WHERE o_orderkey % 2 = 0 GROUP BY 1, 2
UNION ALL SELECT DISTINCT o_custkey, o_orderpriority, 1 FROM orders o WHERE o_orderkey % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM orders b WHERE b.o_orderkey % 2 = 0 AND b.o_custkey = o.o_custkey AND b.o_orderpriority = o.o_orderpriority)""",
)
def insert_ignore(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("match_id"), F.col("o_orderpriority").alias("video_id"),
        (F.col("o_orderkey") % 2).alias("origin"),
    )
    base = rows.where("origin = 0").distinct()
    return writes.insert_ignore(base, rows.where("origin = 1"), ["match_id", "video_id"])


@query(
    "conditional_upsert",
    """SELECT o_custkey AS source_id, 'completed' AS status, max(o_orderkey) AS payload FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT o_custkey, 'failed', o_orderkey FROM orders WHERE o_orderstatus <> 'F'""",
)
def conditional_upsert(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("source_id"), status.alias("status"), F.col("o_orderkey").alias("payload"),
        F.col("o_orderkey").alias("seq"),
    )
    middle = rows.agg(F.expr("max(seq) / 2").alias("m")).first()[0]
    early, late = rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)
    start = writes.upsert_extractions(early.limit(0).drop("seq"), early, ["source_id"], "seq")
    return writes.upsert_extractions(start, late, ["source_id"], "seq")


@query(
    "not_yet_extracted",
    """SELECT p_partkey FROM part WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity > 45)""",
)
def not_yet_extracted(spark, sf):
    tag = {c: F.lit(c) for c in ("match_natural_key", "source_type", "provider", "model", "prompt_version")}
    candidates = table(spark, sf, "part").select(F.col("p_partkey").alias("external_id")).withColumns(tag)
    status = F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45), "completed").otherwise("failed")
    extractions = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("external_id"), status.alias("status")
    ).withColumns(tag)
    return cl.not_yet_extracted(candidates, extractions).select(F.col("external_id").alias("p_partkey"))


@query(
    "extraction_submissions",
    """SELECT 'openai:' || o_orderkey || ':m' || (o_custkey % 3) || ':youtube-claims-v1'
    || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ':failed' END AS batch_key,
  'youtube:' || o_orderkey AS source_key, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status
FROM orders""",
)
def extraction_submissions(spark, sf):
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("video_id"), F.lit("t").alias("title"), F.lit("u").alias("url"),
        F.col("o_orderdate").alias("published_at"), F.lit("m").alias("match_natural_key"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"),
        F.array().cast("array<string>").alias("matched_queries"), F.col("o_orderdate").alias("extracted_at"),
        F.when(F.col("o_orderstatus") == "F", none).otherwise("broken").alias("error_message"),
    )
    return cl.extraction_submissions(rows).select("batch_key", "source_key", "status")


# ---------------------------------------------------------------- text functions


@query(
    "slugs_and_labels",
    r"""SELECT doc_id, trim(regexp_replace(lower(left_text), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  regexp_replace(left_text, '[^A-Za-z0-9_.-]+', '_', 'g') AS filename,
  '$' || printf('%.4f', n_chars / 1024.0) AS price
FROM (SELECT doc_id, n_chars, lang || ' / ' || source || ' ' || text AS left_text FROM documents)""",
)
def slugs_and_labels(spark, sf):
    label = F.concat(F.col("lang"), F.lit(" / "), F.col("source"), F.lit(" "), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", text.slugify(label).alias("slug"), text.safe_filename(label).alias("filename"),
        text.dollars(F.col("n_chars") / 1024.0).alias("price"),
    )


@query(
    "timestamps",
    """SELECT doc_id, n_chars AS seconds, CASE WHEN n_chars >= 3600 THEN printf('%02d:', n_chars // 3600) ELSE '' END
  || printf('%02d:%02d', n_chars % 3600 // 60, n_chars % 60) AS label,
  'https://video.example/' || doc_id || '&t=' || n_chars || 's' AS link FROM documents""",
)
def timestamps(spark, sf):
    label = text.format_seconds("n_chars")
    url = F.concat(F.lit("https://video.example/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id", text.timestamp_seconds(label).cast("long").alias("seconds"), label.alias("label"),
        text.deep_link(url, label).alias("link"),
    )


@query(
    "context_replaced",
    """SELECT doc_id, sha256(replace(replace(text || CASE doc_id % 3 WHEN 0 THEN ' the morning session'
      WHEN 1 THEN ' open draft' ELSE '' END, 'morning session', 'evening session'), 'open draft', 'final draft'))
  AS body_sha FROM documents""",
)
def context_replaced(spark, sf):
    phrases = {"morning session": "evening session", "open draft": "final draft"}
    tail = (
        F.when(F.col("doc_id") % 3 == 0, " the morning session")
        .when(F.col("doc_id") % 3 == 1, " open draft").otherwise("")
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(text.replace_context(F.concat("text", tail), phrases), 256).alias("body_sha")
    )


@query(
    "redacted_errors",
    """SELECT page_id, replace(replace(url || ' key=' || 'a b+' || page_id || ' a+b%2B' || page_id, 'a b+' || page_id, '[REDACTED]'),
  'a+b%2B' || page_id, '[REDACTED]') AS message FROM pages""",
)
def redacted_errors(spark, sf):
    number = F.col("page_id").cast("string")
    secret = F.concat(F.lit("a b+"), number)
    message = F.concat("url", F.lit(" key="), secret, F.lit(" a+b%2B"), number)
    return table(spark, sf, "pages").select("page_id", text.redact(message, secret).alias("message"))


@query(
    "alias_maps",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'historical_event' WHEN 1 THEN 'durable_style' WHEN 2 THEN 'current_form'
    ELSE 'Other' END AS temporal,
  CASE event_id % 5 WHEN 0 THEN 'observed_match_event' WHEN 1 THEN 'Style' WHEN 2 THEN ' current' ELSE 'Other' END AS kind,
  CASE event_id % 5 WHEN 0 THEN 'observed_match_event' WHEN 1 THEN 'Style' WHEN 2 THEN ' current' ELSE 'Other' END AS basis
FROM events""",
)
def alias_maps(spark, sf):
    words = F.array(*map(F.lit, ("Historical_Context ", "Style", " current", "Other", "Other")))
    word = F.get(words, (F.col("event_id") % 5).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", text.alias(word, vocab.TEMPORAL_ALIASES).alias("temporal"),
        text.alias(word, vocab.EVIDENCE_KIND_ALIASES).alias("kind"),
        text.alias(word, vocab.SOURCE_BASIS_ALIASES).alias("basis"),
    )
