"""Schemas of the canonical tables and readers that check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dyadflow.functions import vocab


def _schema(ddl: str, **enums: list[str]) -> tuple[str, dict[str, list[str]]]:
    return ddl, enums


_CONTRACTS = {
    "athletes": _schema("athlete_id long not null, canonical_name string not null"),
    "events": _schema(
        "event_id long not null, slug string not null, promoter string not null, "
        "name string not null, held_on date not null"
    ),
    "matches": _schema(
        "match_id long not null, natural_key string not null, label string, arm string not null, "
        "weight_class string not null, scheduled_at timestamp not null, event_id long not null, "
        "status string not null",
        arm=vocab.ARMS, status=vocab.MATCH_STATUSES,
    ),
    "match_competitors": _schema(
        "match_id long not null, athlete_id long not null, score int, result string",
        result=vocab.COMPETITOR_RESULTS,
    ),
    "match_videos": _schema("match_id long not null, video_id string not null"),
    "sources": _schema(
        "source_id long not null, source_type string not null, external_id string not null, "
        "url string not null, title string, published_at timestamp, raw_payload string"
    ),
    "source_extractions": _schema(
        "source_id long not null, match_id long not null, provider string not null, "
        "model string not null, prompt_version string not null, status string not null, "
        "extracted_at timestamp not null, raw_response string, usage string, error_message string",
        status=["completed", "failed"],
    ),
    "claims": _schema(
        "claim_id long not null, source_id long not null, match_id long not null, "
        "claim_text string not null, timestamp_seconds int, speaker string, confidence string, "
        "relevance string, observed_at timestamp, extracted_at timestamp not null, "
        "extraction_model string"
    ),
    "claim_subjects": _schema("claim_id long not null, athlete_id long not null"),
    "claim_annotations": _schema(
        "claim_id long not null, model string not null, prompt_version string not null, "
        "claim_type string not null, concepts array<string> not null, subject_athlete_id long, "
        "arm string, temporality string not null, certainty string not null",
        claim_type=vocab.CLAIM_TYPES, concepts=vocab.CONCEPTS, arm=vocab.ARMS,
        temporality=vocab.TEMPORALITIES, certainty=vocab.CERTAINTIES,
    ),
}

KEYS: dict[str, list[str]] = {
    "athletes": ["canonical_name"],
    "events": ["slug"],
    "matches": ["natural_key"],
    "match_competitors": ["match_id", "athlete_id"],
    "match_videos": ["match_id", "video_id"],
    "sources": ["source_type", "external_id"],
    "source_extractions": ["source_id", "match_id", "provider", "model", "prompt_version"],
    "claims": ["source_id", "timestamp_key", "claim_text"],
    "claim_subjects": ["claim_id", "athlete_id"],
    "claim_annotations": ["claim_id", "model", "prompt_version"],
}


def schema(name: str) -> T.StructType:
    """Schema of a canonical table; enumerations are in the fields' metadata."""
    ddl, enums = _CONTRACTS[name]
    return T.StructType(
        [
            T.StructField(f.name, f.dataType, f.nullable, {"enum": enums[f.name]} if f.name in enums else {})
            for f in T.StructType.fromDDL(ddl).fields
        ]
    )


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(path)


def read_jdbc_table(spark: SparkSession, name: str, url: str, split_on: str, bounds: tuple[int, int], parts: int) -> DataFrame:
    """A table of a relational store, read in parallel by ranges of a numeric column."""
    return spark.read.jdbc(
        url, name, column=split_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts
    )
