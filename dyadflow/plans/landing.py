"""Registered queries of the landed JSON: documents and pages of the driver's tables, landed and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions import vocab
from dyadflow.operators import claims as cl
from dyadflow.operators import validation
from dyadflow.plans.fixtures import table
from dyadflow.sources import artifacts, results_csv
from dyadflow.staging import stage_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return add


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, document): every document as a model's answer, with claims of several shapes."""
    kind = F.col("doc_id") % 4
    claim = lambda c, who: F.to_json(F.struct(c.alias("claim"), who.alias("speaker_or_source")))
    whole = claim(F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("?")))
    second = claim(F.concat(F.lit("of "), F.coalesce("lang", F.lit("?"))), F.lit("b"))
    stray = F.when(kind == 0, F.lit("7")).when(kind == 1, F.lit('"text"')).otherwise(F.lit("null"))
    elements = F.concat(F.lit("["), F.concat_ws(",", whole, stray, second), F.lit("]"))
    analysis = F.when(kind == 3, F.lit('"nothing"')).when(kind == 2, elements).otherwise(
        F.concat(F.lit('{"summary":"s","claims":'), elements, F.lit("}"))
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit('{"analysis":'), analysis, F.lit("}")).alias("document")
    )


@query(
    "landed_claims",
    """SELECT doc_id, 0 AS pos, sha256(coalesce(text, '')) AS claim_sha256, coalesce(source, '?') AS speaker_or_source
FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 2, sha256('of ' || coalesce(lang, '?')), 'b' FROM documents WHERE doc_id % 4 <> 3""",
)
def landed_claims(spark, sf):
    return artifacts.analysis_claims(_answers(spark, sf)).select(
        "doc_id", "pos", F.sha2("claim", 256).alias("claim_sha256"), "speaker_or_source"
    )


@query(
    "landed_claim_problems",
    """SELECT doc_id, 1 AS pos, CASE doc_id % 4 WHEN 0 THEN '7' WHEN 1 THEN 'text' END AS element,
  'claim is no object' AS problem FROM documents WHERE doc_id % 4 <> 3""",
)
def landed_claim_problems(spark, sf):
    return artifacts.claim_element_problems(_answers(spark, sf))


@query(
    "landed_segments",
    """SELECT conv_id, turn, 0 AS pos, turn * 2.5::DOUBLE AS start_seconds, turn * 2.5::DOUBLE + 1.0 AS end_seconds,
  sha256(trim(coalesce(role, ''), ' ')) AS text_sha256 FROM conversations
UNION ALL SELECT conv_id, turn, 1, turn * 2.5::DOUBLE + 1.0, turn * 2.5::DOUBLE + 2.0,
  sha256(trim(coalesce(text, ''), ' ')) FROM conversations""",
)
def landed_segments(spark, sf):
    at = F.col("turn") * F.lit(2.5).cast("double")
    padded = lambda c: F.concat(F.lit(" "), F.coalesce(F.col(c), F.lit("")), F.lit(" "))
    segment = lambda start, words: F.struct(
        (at + start).alias("start"), (at + start + 1.0).alias("end"), padded(words).alias("text")
    )
    document = F.to_json(F.struct(F.array(segment(0.0, "role"), segment(1.0, "text")).alias("segments")))
    landed = table(spark, sf, "conversations").select("conv_id", "turn", document.alias("document"))
    return artifacts.transcript_segments(landed).select(
        "conv_id", "turn", "pos", "start_seconds", "end_seconds", F.sha2("text", 256).alias("text_sha256")
    )


@query(
    "landed_search",
    """SELECT 'v' || page_id AS id, 'q' || (page_id % 5) AS query, page_id AS list_ord, 0 AS rank, url AS title,
  sha256(html) AS description_sha256 FROM pages WHERE page_id % 3 <> 0""",
)
def landed_search(spark, sf):
    video = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("v"), F.col("page_id").cast("string")))
    item = F.struct(
        F.struct(video.alias("videoId")).alias("id"),
        F.struct(F.col("url").alias("title"), F.col("html").alias("description")).alias("snippet"),
    )
    landed = table(spark, sf, "pages").select(
        F.concat(F.lit("q"), (F.col("page_id") % 5).cast("string")).alias("query"), F.col("page_id").alias("list_ord"),
        F.to_json(F.struct(F.array(item).alias("items"))).alias("document"),
    )
    return artifacts.search_candidates(landed).select(
        "id", "query", "list_ord", "rank", "title", F.sha2("description", 256).alias("description_sha256")
    )


@query(
    "landed_videos",
    """SELECT 'v' || page_id AS id, url AS title, 'PT' || (page_id % 90) || 'M' AS duration,
  CASE WHEN page_id % 7 = 0 THEN 0 ELSE page_id * 3 END AS view_count,
  CASE WHEN page_id % 2 = 0 THEN page_id END AS like_count FROM pages""",
)
def landed_videos(spark, sf):
    page = F.col("page_id")
    text = lambda c: c.cast("string")
    item = F.struct(
        F.concat(F.lit("v"), text(page)).alias("id"), F.struct(F.col("url").alias("title")).alias("snippet"),
        F.struct(F.concat(F.lit("PT"), text(page % 90), F.lit("M")).alias("duration")).alias("contentDetails"),
        F.struct(
            F.when(page % 7 == 0, F.lit("hidden")).otherwise(text(page * 3)).alias("viewCount"),
            F.when(page % 2 == 0, text(page)).alias("likeCount"),
        ).alias("statistics"),
    )
    landed = table(spark, sf, "pages").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("document"))
    return artifacts.video_metadata(landed).select("id", "title", "duration", "view_count", "like_count")


@query(
    "landed_fallback",
    """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS decoded_chars,
  CASE WHEN doc_id % 5 = 0 THEN sha256('no json: ' || coalesce(text, '')) END AS raw_sha256 FROM documents""",
)
def landed_fallback(spark, sf):
    landed = F.to_json(F.struct(F.col("n_chars").alias("chars"), "text"))
    broken = F.concat(F.lit("no json: "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, broken).otherwise(landed).alias("document")
    )
    return artifacts.with_fallback(rows, "document", "struct<chars:bigint,text:string>").select(
        "doc_id", F.col("decoded.chars").alias("decoded_chars"), F.sha2("raw_text", 256).alias("raw_sha256")
    )


@query(
    "nested_dimensions",
    """WITH k AS (SELECT o_orderkey AS k, 60 + o_orderkey % 90 AS kg FROM orders)
SELECT k AS evidence_index, CASE k % 3 WHEN 0 THEN 'measurement' WHEN 1 THEN 'gym_lift_proxy' ELSE 'unclear' END AS evidence_kind,
  concat_ws(';', CASE k % 4 WHEN 0 THEN 'reach=70::medium' WHEN 1 THEN 'tall=::low' WHEN 2 THEN 'body_weight=' || kg || '::medium' END,
    CASE WHEN k % 3 = 0 AND k % 4 <> 2 THEN 'body_weight=' || kg || ':kg:medium' END) AS measurements,
  concat_ws(';', CASE k % 5 WHEN 0 THEN 'curl=::medium' WHEN 1 THEN 'row=::low' END,
    CASE WHEN k % 3 = 1 THEN 'back_pressure=' || (20 + k % 50) || '-' || (70 + k % 30) || ':kg:low' END) AS lifts,
  CASE k % 7 WHEN 0 THEN 'old bout=::low' WHEN 1 THEN 'm=p::medium' ELSE '' END AS lessons
FROM k""",
)
def nested_dimensions(spark, sf):
    k = F.col("o_orderkey")
    say = lambda *parts: F.concat(*[p.cast("string") if hasattr(p, "cast") else F.lit(p) for p in parts])
    orders = table(spark, sf, "orders")
    claim = F.when(k % 3 == 0, say("Body weight ", 60 + k % 90, " kg")).when(
        k % 3 == 1, say("back pressure at ", 20 + k % 50, "-", 70 + k % 30, " kg")
    ).otherwise("no numbers")
    claims = orders.select(k.alias("evidence_index"), claim.alias("claim"), F.lit(None).cast("string").alias("relevance"))
    items = orders.select(
        k.alias("evidence_index"), F.lit(None).cast("string").alias("evidence_kind"),
        F.when(k % 4 == 0, F.array(F.lit('{"type":"reach","value":"70"}'))).when(k % 4 == 1, F.array(F.lit("tall")))
        .when(k % 4 == 2, F.array(say('{"metric":"body_weight","value":', 60 + k % 90, "}"))).alias("measurements"),
        F.when(k % 5 == 0, F.array(F.lit('{"lift_name":"curl"}'))).when(k % 5 == 1, F.array(F.lit("row"))).alias("lifts"),
        F.when(k % 7 == 0, F.array(F.lit("old bout"))).when(
            k % 7 == 1, F.array(F.lit('{"referenced_opponent_or_match":"m","tested_property":"p"}'))
        ).alias("transferable_lessons"),
    )
    flat = lambda c, a, b, u, q: F.array_join(F.transform(c, lambda x: F.concat(
        x[a], F.lit("="), x[b], F.lit(":"), x[u], F.lit(":"), x[q])), ";")
    return cl.nested_dimensions(items, claims).select(
        "evidence_index", "evidence_kind",
        flat("measurements", "metric", "value", "unit", "confidence").alias("measurements"),
        flat("lifts", "lift_name", "value", "unit", "confidence").alias("lifts"),
        flat("transferable_lessons", "referenced_opponent_or_match", "tested_property", "transfers_how", "transfer_strength")
        .alias("lessons"),
    )


@query(
    "landed_results",
    """SELECT CAST(o_orderkey AS VARCHAR) AS event_slug, CAST(o_orderkey % 2 AS INTEGER) AS folder,
  CAST(o_orderkey // 2 % 16 AS INTEGER) AS bucket, row_number() OVER (
    PARTITION BY o_orderkey % 2, o_orderkey // 2 % 16 ORDER BY o_orderkey) + 1 AS row_number,
  CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS BIGINT) AS n_problems
FROM orders""",
)
def landed_results(spark, sf):
    """Orders as result files, equal file names in two folders, read back with their line numbers; an open
    order has scores, which is right for completed matches only."""
    key = F.col("o_orderkey")
    values = {
        "event_slug": key.cast("string"), "event_name": F.lit('Cup, "open"'), "promoter": F.lit("C"),
        "event_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "arm": F.lit("right"), "weight_class": F.lit("105 kg"),
        "athlete_a": F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "athlete_b": F.lit("other"),
        "score_a": F.lit("3"), "score_b": F.lit("1"),
        "status": F.when(F.col("o_orderstatus") == "O", "completed").otherwise("dq"), "video_id": F.lit(""), "bout": F.lit(""),
    }
    rows = table(spark, sf, "orders").select(
        *[values[c].alias(c) for c in vocab.RESULT_COLUMNS], key.alias("_key"),
        (key % 2).cast("int").alias("folder"), F.expr("CAST(o_orderkey div 2 % 16 AS INT)").alias("bucket"),
    )
    # a task that holds a bucket writes a file of the same name into both folders
    path = stage_path(spark, "results")
    ordered = rows.repartition("bucket").sortWithinPartitions("folder", "bucket", "_key").drop("_key")
    ordered.write.partitionBy("folder", "bucket").option("header", True).option("escape", '"').csv(path)
    numbered = results_csv.with_row_numbers(results_csv.read_results(spark, path))
    return validation.validate_results(numbered).select(
        "event_slug", "folder", "bucket", "row_number", F.size("problems").cast("long").alias("n_problems")
    )
