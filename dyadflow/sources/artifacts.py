"""Landed JSON: model answers, evaluations, transcripts, video search and metadata."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.operators.discovery import Seeds

CLAIM = "struct<timestamp:string,claim:string,speaker_or_source:string,relevance:string,confidence:string>"
ANALYSIS_SCHEMA = (
    "struct<summary:string,popular_take:string,counter_case:string,key_question:string,claims:array<string>>"
)
USAGE_SCHEMA = (
    "struct<promptTokenCount:bigint,candidatesTokenCount:bigint,totalTokenCount:bigint,"
    "promptTokensDetails:array<struct<modality:string,tokenCount:bigint>>>"
)
TRANSCRIPT_SCHEMA = (
    "struct<text:string,language:string,segments:array<struct<start:double,`end`:double,text:string>>>"
)
SEARCH_SCHEMA = (
    "struct<items:array<struct<id:struct<videoId:string>,snippet:struct<title:string,"
    "channelTitle:string,channelId:string,publishedAt:string,description:string>>>>"
)
METADATA_SCHEMA = (
    "struct<items:array<struct<id:string,snippet:struct<title:string,channelTitle:string,"
    "publishedAt:string,description:string>,contentDetails:struct<duration:string,caption:string>,"
    "statistics:struct<viewCount:string,likeCount:string>,status:struct<license:string>>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: its text, and the video, model and kind its name stands for.

    Names are ``<video>.json``, ``<video>__<model>.json`` or ``<video>__<model>__<kind>_eval.json``.
    Video ids have eleven characters and may contain the separator themselves; other ids end at
    the first one.
    """
    encoded = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    stem = F.coalesce(F.try_url_decode(encoded), encoded)
    judged = F.rlike(stem, F.lit(r"__[A-Za-z0-9]+_eval$"))
    name = F.regexp_replace(stem, r"__[A-Za-z0-9]+_eval$", "")
    full_id = F.rlike(name, F.lit(r"^.{11}(__.*)?$"))
    video = F.when(full_id, F.substring(name, 1, 11)).otherwise(F.substring_index(name, "__", 1))
    rest = F.substring(name, F.length(video) + 3, F.length(name))
    return (
        spark.read.text(path, wholetext=True)
        .select(
            video.alias("video_id"),
            F.nullif(rest, F.lit("")).alias("model"),
            judged.alias("is_evaluation"),
            F.col("value").alias("document"),
        )
    )


def decode(document: Column | str, schema: str) -> Column:
    """JSON text to a struct; text that is no JSON gives null and stays available as it is."""
    return F.from_json(document, schema, {"mode": "PERMISSIVE"})


def with_fallback(rows: DataFrame, document: str, schema: str) -> DataFrame:
    """Append ``decoded`` and, where decoding failed, the raw text as ``raw_text``."""
    parsed = F.try_parse_json(document)
    return rows.withColumn("decoded", F.when(parsed.isNotNull(), decode(document, schema))).withColumn(
        "raw_text", F.when(parsed.isNull(), F.col(document))
    )


def _claim_elements(documents: DataFrame, document: str) -> DataFrame:
    """Elements of the claim lists as JSON text, with their position in the answer."""
    analysis = F.get_json_object(document, "$.analysis")
    is_list = F.startswith(F.ltrim(analysis), F.lit("["))
    listed = F.when(is_list, analysis).otherwise(F.get_json_object(document, "$.analysis.claims"))
    keep = [c for c in documents.columns if c != document]
    return documents.select(*keep, F.posexplode(F.from_json(listed, "array<string>")).alias("pos", "_element"))


def _is_object(element: str) -> Column:
    return F.startswith(F.ltrim(element), F.lit("{"))


def analysis_claims(documents: DataFrame, document: str = "document") -> DataFrame:
    """Claims of model answers whose ``analysis`` is an object with claims or a bare list.

    Elements are read one by one, so one that is no object costs only itself (``claim_element_problems``
    names it). Anything else has no claims. Output rows carry the position of the claim in its answer.
    """
    keep = [c for c in documents.columns if c != document]
    return (
        _claim_elements(documents, document).where(_is_object("_element"))
        .select(*keep, "pos", F.from_json("_element", CLAIM).alias("c"))
        .select(*keep, "pos", "c.*")
    )


def claim_element_problems(documents: DataFrame, document: str = "document") -> DataFrame:
    """Elements of claim lists that are no objects, nulls included, with their position."""
    keep = [c for c in documents.columns if c != document]
    element = F.col("_element").alias("element")
    return (
        _claim_elements(documents, document).where(~F.coalesce(_is_object("_element"), F.lit(False)))
        .select(*keep, "pos", element, F.lit("claim is no object").alias("problem"))
    )


def analysis_summary(document: Column | str = "document") -> Column:
    """Struct of the summary texts; null fields where the analysis is a list."""
    return F.from_json(F.get_json_object(document, "$.analysis"), ANALYSIS_SCHEMA)


def usage(document: Column | str = "document") -> Column:
    return F.from_json(F.get_json_object(document, "$.usage_metadata"), USAGE_SCHEMA)


def transcript_segments(rows: DataFrame, document: str = "document") -> DataFrame:
    """Segments of verbose transcripts, text trimmed."""
    keep = [c for c in rows.columns if c != document]
    return (
        rows.withColumn("_t", F.from_json(document, TRANSCRIPT_SCHEMA))
        .select(*keep, F.posexplode("_t.segments").alias("pos", "s"))
        .select(
            *keep, "pos", F.col("s.start").alias("start_seconds"), F.col("s.end").alias("end_seconds"),
            F.trim("s.text").alias("text"),
        )
    )


def search_candidates(rows: DataFrame, document: str = "document") -> DataFrame:
    """Candidates of landed search answers (query, list_ord, document), in list order."""
    return (
        rows.withColumn("_s", F.from_json(document, SEARCH_SCHEMA))
        .select("query", "list_ord", F.posexplode("_s.items").alias("rank", "i"))
        .where("i.id.videoId IS NOT NULL AND i.id.videoId <> ''")
        .select(
            F.col("i.id.videoId").alias("id"), "query", "list_ord", "rank",
            F.col("i.snippet.title").alias("title"), F.col("i.snippet.channelTitle").alias("channel"),
            F.col("i.snippet.publishedAt").alias("published_at"),
            F.col("i.snippet.description").alias("description"),
        )
    )


def video_metadata(rows: DataFrame, document: str = "document") -> DataFrame:
    """Videos of landed metadata answers; counts are numbers, likes stay null when hidden."""
    return (
        rows.select(F.explode(F.from_json(document, METADATA_SCHEMA)["items"]).alias("i"))
        .select(
            F.col("i.id").alias("id"), F.col("i.snippet.title").alias("title"),
            F.col("i.snippet.channelTitle").alias("channel"),
            F.col("i.snippet.publishedAt").alias("published_at"),
            F.col("i.snippet.description").alias("description"),
            F.col("i.contentDetails.duration").alias("duration"),
            F.col("i.contentDetails.caption").alias("caption"),
            F.coalesce(F.col("i.statistics.viewCount").try_cast("long"), F.lit(0)).alias("view_count"),
            F.col("i.statistics.likeCount").try_cast("long").alias("like_count"),
            F.col("i.status.license").alias("license"),
            F.concat(F.lit("https://www.youtube.com/watch?v="), "i.id").alias("url"),
        )
    )


def read_seeds(path: str, targets: tuple[str, str]) -> Seeds:
    """Scoring configuration from a small JSON or YAML file next to the job."""
    with open(path, encoding="utf-8") as handle:
        content = handle.read()
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional dependency

        data = yaml.safe_load(content)
    else:
        data = json.loads(content)
    return Seeds(
        {c["name"]: int(c["priority"]) for c in data.get("trusted_channels", [])},
        list(data.get("positive_title_terms", [])),
        list(data.get("negative_title_terms", [])),
        targets,
    )
