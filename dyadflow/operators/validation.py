"""Rules that collect every problem of a row, and what to do with the rows that have some."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadflow.functions import text, vocab


def collect_problems(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """Sorted array of the messages whose condition holds; a null condition does not count."""
    found = [
        F.when(violated, message if isinstance(message, Column) else F.lit(message))
        for violated, message in rules
    ]
    return F.sort_array(F.array_compact(F.array(*found)))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("problems") == 0).drop("problems")


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("problems") > 0)


def accepted_files(rows: DataFrame, file_key: str) -> DataFrame:
    """Whole-file mode: one bad row rejects every row of its file."""
    bad = quarantine(rows).select(file_key).distinct()
    return rows.join(bad, file_key, "left_anti").drop("problems")


def outcome_counts(rows: DataFrame, by: Sequence[str] = (), skipped: Column | None = None) -> DataFrame:
    """Selected, completed and failed rows of a batch; with ``skipped``, rows that were not tried as well."""
    failed = F.size("problems") > 0
    if skipped is not None:
        tried = ~F.coalesce(skipped, F.lit(False))
        return rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("selected"),
            F.count_if(tried & ~failed).alias("completed"),
            F.count_if(tried & failed).alias("failed"),
            F.count_if(~tried).alias("skipped"),
        )
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(~failed).alias("completed"),
        F.count_if(failed).alias("failed"),
    )


# ------------------------------------------------------------------ result files


def validate_results(rows: DataFrame) -> DataFrame:
    """Typed columns and ``problems`` for raw result rows (all text, trimmed here).

    Sides may meet again on one day only with distinct bout minutes, which then become part of the
    scheduled time. That rule looks at the rows of one file that are otherwise fine. Lines with too
    few or too many fields (``_corrupt``) are problems.
    """
    c = {n: F.coalesce(F.btrim(n, F.lit(text.WHITESPACE)), F.lit("")) for n in vocab.RESULT_COLUMNS}
    clean = rows.select(
        *[x for x in rows.columns if x not in c], *[v.alias(n) for n, v in c.items()]
    )
    integer = r"^[+-]?[0-9]+$"
    typed = clean.select(
        "*",
        F.when(F.col("event_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("event_date").try_cast("date")).alias("_date"),
        *[
            F.when(F.col(s).rlike(integer), F.col(s).try_cast("int")).alias(f"_{s}")
            for s in ("score_a", "score_b", "bout")
        ],
    )
    blank = lambda n: F.col(n) == ""
    bad_score = lambda s: ~blank(s) & F.coalesce(F.col(f"_{s}") < 0, F.lit(True))
    readable = ~bad_score("score_a") & ~bad_score("score_b")
    done = F.col("status") == "completed"
    decided = F.coalesce(F.col("_score_a") != F.col("_score_b"), F.lit(False)) & readable
    bad_bout = ~blank("bout") & ~F.coalesce(
        F.col("_bout").between(1, vocab.MAX_BOUT_MINUTE), F.lit(False)
    )
    rules = [(blank(n), f"missing {n}") for n in vocab.REQUIRED_RESULT_COLUMNS]
    rules += [
        (F.col("_date").isNull(), "invalid event_date"),
        (bad_bout, "bout must be a minute from 1 through 1439"),
        (bad_score("score_a"), "non-numeric score in score_a"),
        (bad_score("score_b"), "non-numeric score in score_b"),
        (~F.col("arm").isin(*vocab.ARMS), F.concat(F.lit("unrecognized arm "), "arm")),
        (
            ~F.col("status").isin(*vocab.CSV_STATUSES),
            F.concat(F.lit("unrecognized status "), "status"),
        ),
        (
            ~done & readable & (~blank("score_a") | ~blank("score_b")),
            "scores are allowed only for completed matches",
        ),
        (done & ~decided, "completed match requires unequal numeric scores"),
    ]
    if "_corrupt" in rows.columns:
        rules.insert(0, (F.col("_corrupt").isNotNull(), "wrong number of columns"))
    file = ["batch_key"] if "batch_key" in rows.columns else []
    checked = typed.withColumn("problems", collect_problems(rules)).withColumn(
        "_bout", F.coalesce("_bout", F.lit(0))
    )
    first, second = F.lower("athlete_a"), F.lower("athlete_b")
    keyed = checked.withColumn(
        "_meeting",
        F.concat_ws(
            "|", *file, "event_slug", "arm", F.least(first, second), F.greatest(first, second), "event_date"
        ),
    )
    repeated = (
        keyed.where(F.size("problems") == 0)
        .groupBy("_meeting")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_distinct("_bout").alias("_distinct"),
            F.min("_bout").alias("_first"),
        )
        .where("_n > 1")
        .select("_meeting", ((F.col("_first") == 0) | (F.col("_distinct") < F.col("_n"))).alias("_clash"))
    )
    fine = F.size("problems") == 0
    joined = keyed.join(repeated, "_meeting", "left")
    clash = F.array(F.lit("repeated same-day match requires distinct bout values"))
    start = F.col("_date").cast("timestamp")
    shifted = F.timestamp_add("MINUTE", F.col("_bout"), start)
    return joined.select(
        *[x for x in clean.columns if x not in ("score_a", "score_b", "bout", "event_date")],
        F.col("_date").alias("event_date"),
        F.col("_score_a").alias("score_a"),
        F.col("_score_b").alias("score_b"),
        F.col("_bout").alias("bout"),
        F.when(F.col("_clash").isNotNull() & fine, shifted).otherwise(start).alias("scheduled_at"),
        F.when(fine & F.coalesce("_clash", F.lit(False)), clash)
        .otherwise(F.col("problems"))
        .alias("problems"),
    )


# ------------------------------------------------------------------ submissions


def result_submission_problems(rows: DataFrame) -> DataFrame:
    """Append ``problems`` to nested result submissions.

    Columns: schema_version, batch_key, event struct(slug, promoter, name, held_on), arm,
    weight_class, status, scheduled_at, competitors array of struct(athlete_name, score, result),
    video_ids array of text.
    """
    sides = F.coalesce(F.col("competitors"), F.array().cast(rows.schema["competitors"].dataType))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    event = [F.col(f"event.{n}") for n in ("slug", "promoter", "name")]
    completed = F.col("status") == "completed"
    names = F.filter(F.transform(sides, lambda s: s["athlete_name"]), lambda n: ~blank(n))
    winners = F.size(F.filter(sides, lambda s: s["result"] == "win"))
    known = [*vocab.COMPETITOR_RESULTS, ""]
    no_event = blank(event[0]) | blank(event[1]) | blank(event[2]) | F.col("event.held_on").isNull()
    rules = [
        (
            ~F.col("schema_version").eqNullSafe(F.lit(vocab.RESULT_SCHEMA_VERSION)),
            "unsupported result submission schema version",
        ),
        (blank(F.col("batch_key")), "result submission requires a batch key"),
        (
            no_event,
            "result submission requires an event with slug, promoter, name, and held-on date",
        ),
        (
            ~F.coalesce("arm", F.lit("")).isin(*vocab.ARMS),
            F.concat(F.lit("unrecognized arm: "), F.coalesce("arm", F.lit(""))),
        ),
        (blank(F.col("weight_class")), "result submission requires a weight class"),
        (
            ~F.coalesce("status", F.lit("")).isin(*vocab.MATCH_STATUSES),
            F.concat(F.lit("unrecognized status: "), F.coalesce("status", F.lit(""))),
        ),
        (F.col("scheduled_at").isNull(), "result submission requires a scheduled-at date"),
        (F.size(sides) != 2, "result submission requires exactly two competitors"),
        (F.exists(sides, lambda s: blank(s["athlete_name"])), "competitor requires a name"),
        (F.size(names) > F.size(F.array_distinct(names)), "duplicate competitor name"),
        (
            F.exists(sides, lambda s: ~F.coalesce(s["result"], F.lit("")).isin(*known)),
            "competitor has an unrecognized result",
        ),
        (
            completed & F.exists(sides, lambda s: s["score"].isNull()),
            "competitor requires a score for a completed match",
        ),
        (completed & (winners != 1), "a completed match requires exactly one winner"),
        (
            F.exists(F.coalesce("video_ids", F.array().cast("array<string>")), lambda v: blank(F.trim(v))),
            "video requires an id",
        ),
    ]
    return rows.withColumn("problems", collect_problems(rules))


def _row_problems(rows: DataFrame, rules: Sequence[tuple[Column, Column | str]]) -> DataFrame:
    found = rows.select("batch_key", F.explode(collect_problems(rules)).alias("problem"))
    return found.distinct()


def _blank(*names: str) -> Column:
    return _any([F.coalesce(F.col(n), F.lit("")) == "" for n in names])


def evidence_problems(
    submissions: DataFrame, sources: DataFrame, extractions: DataFrame, claims: DataFrame
) -> DataFrame:
    """Every problem of evidence batches as (batch_key, problem) rows.

    The four parts of a batch are tables keyed by ``batch_key``. Each is read once for its own
    rules; references between them are anti-joins, so a huge batch is spread over the cluster like
    any other rows.
    """
    source_fields = ("key", "source_type", "external_id", "url")
    extraction_fields = ("key", "source_key", "provider", "model", "prompt_version")
    failed, completed = F.col("status") == "failed", F.col("status") == "completed"
    has_error = F.col("error_message").isNotNull()
    own = [
        _row_problems(
            submissions,
            [
                (
                    ~F.col("schema_version").eqNullSafe(F.lit(vocab.EVIDENCE_SCHEMA_VERSION)),
                    "unsupported evidence submission schema version",
                ),
                (
                    _blank("batch_key", "match_natural_key"),
                    "evidence submission requires batch key and match natural key",
                ),
            ],
        ),
        _row_problems(
            sources,
            [(_blank(*source_fields), "sources require key, type, external ID, and URL")],
        ),
        _row_problems(
            extractions,
            [
                (
                    _blank(*extraction_fields) | F.col("extracted_at").isNull(),
                    "extractions require key, source, provider, model, prompt version, and extracted-at",
                ),
                (
                    ~F.coalesce("status", F.lit("")).isin("completed", "failed"),
                    "extraction status must be completed or failed",
                ),
                (failed & ~has_error, "failed extraction requires an error message"),
                (completed & has_error, "completed extraction cannot contain an error message"),
            ],
        ),
        _row_problems(
            claims,
            [
                (
                    _blank("source_key", "text") | F.col("extracted_at").isNull(),
                    "claim requires source, text, and extracted-at",
                ),
                (
                    F.coalesce(F.size("subject_names"), F.lit(0)) <= 0,
                    "claim requires at least one subject",
                ),
            ],
        ),
    ]
    say = lambda rows, message, c: rows.select(
        "batch_key", F.concat(F.lit(message), c).alias("problem")
    )
    complete_sources = sources.where(~_blank(*source_fields))
    between = []
    for part, what in ((complete_sources, "source"), (extractions, "extraction")):
        repeated = part.groupBy("batch_key", "key").agg(F.count(F.lit(1)).alias("_n"))
        between.append(say(repeated.where("_n > 1"), f"duplicate {what} key: ", "key"))
    known_sources = complete_sources.select("batch_key", F.col("key").alias("source_key")).distinct()
    for part, what in ((extractions, "extraction"), (claims, "claim")):
        cited = part.select("batch_key", "source_key").distinct()
        dangling = cited.join(known_sources, ["batch_key", "source_key"], "left_anti")
        between.append(say(dangling, f"{what} references unknown source: ", "source_key"))
    # a key listed more than once stands for the last extraction made
    last = F.max(F.struct("extracted_at", "source_key", "status"))
    known = (
        extractions.groupBy("batch_key", F.col("key").alias("extraction_key"))
        .agg(F.count(F.lit(1)).alias("_n"), last.alias("_last"))
        .select(
            "batch_key", "extraction_key", "_n", F.col("_last.status").alias("_status"),
            F.col("_last.source_key").alias("_source"),
        )
    )
    used = (
        claims.where(~_blank("extraction_key"))
        .select("batch_key", "extraction_key", "source_key")
        .distinct()
        .join(known, ["batch_key", "extraction_key"], "left")
    )
    missing = used.where("_n IS NULL")
    between.append(say(missing, "claim references unknown extraction: ", "extraction_key"))
    unfit = used.where((F.col("_status") != "completed") | (F.col("_source") != F.col("source_key")))
    between.append(
        unfit.select(
            "batch_key",
            F.lit("claim extraction must be completed and reference the same source").alias("problem"),
        )
    )
    problems = own[0]
    for more in (*own[1:], *between):
        problems = problems.unionByName(more)
    return problems.distinct()


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def subject_problems(claims: DataFrame, competitors: DataFrame) -> DataFrame:
    """Claim subjects that are not competitors of the claim's match.

    ``claims`` has (match_id, claim_id, subject_names), ``competitors`` (match_id, name).
    """
    named = claims.select("match_id", "claim_id", F.explode("subject_names").alias("name"))
    return named.join(competitors.select("match_id", "name"), ["match_id", "name"], "left_anti")


def widen_durations(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """A transcript that runs past the stated length extends it."""
    ends = segments.groupBy("video_id").agg(F.ceil(F.max("end_seconds")).cast("long").alias("_end"))
    return (
        videos.join(ends, "video_id", "left")
        .withColumn("duration_seconds", F.greatest("duration_seconds", "_end"))
        .drop("_end")
    )


def extraction_problems(claims: DataFrame) -> DataFrame:
    """Append ``problems`` to extracted claims joined to their video's duration and competitors.

    Columns: text, relevance, timestamp_seconds, duration_seconds, confidence, claim_type,
    subject_names, competitor_names.
    """
    blank = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    outside = (F.col("timestamp_seconds") < 0) | (
        F.col("timestamp_seconds") > F.col("duration_seconds")
    )
    strangers = F.array_except("subject_names", "competitor_names")
    rules = [
        (blank("text") | blank("relevance"), "claim requires text and relevance"),
        (outside, "claim timestamp is outside video duration"),
        (~F.coalesce("confidence", F.lit("")).isin(*vocab.CONFIDENCES), "claim has unknown confidence"),
        (~F.coalesce("claim_type", F.lit("")).isin(*vocab.CLAIM_TYPES), "claim has unknown claim type"),
        (F.size(strangers) > 0, "claim references unknown subject"),
    ]
    return claims.withColumn("problems", collect_problems(rules))


def empty_extraction_problems(extractions: DataFrame) -> DataFrame:
    """Version and emptiness rules of whole extractions (schema_version, claims, limitations)."""
    rules = [
        (
            ~F.col("schema_version").eqNullSafe(F.lit(vocab.EXTRACTION_SCHEMA_VERSION)),
            "unsupported extraction schema version",
        ),
        (
            (F.coalesce(F.size("claims"), F.lit(0)) <= 0)
            & (F.coalesce(F.size("limitations"), F.lit(0)) <= 0),
            "zero claims require a limitation",
        ),
    ]
    return extractions.withColumn("problems", collect_problems(rules))


def annotation_problems(annotations: DataFrame) -> DataFrame:
    """Append ``problems`` to claim annotations."""
    known = F.array(*map(F.lit, vocab.CONCEPTS))
    unknown_concept = F.size(F.array_except("concepts", known)) > 0
    one_of = lambda n, values: ~F.coalesce(F.col(n), F.lit("")).isin(*values)
    rules = [
        (one_of("claim_type", vocab.CLAIM_TYPES), "unrecognized claim_type"),
        (F.coalesce(F.size("concepts"), F.lit(0)) <= 0, "annotation requires at least one concept"),
        (unknown_concept, "unrecognized concept"),
        (one_of("arm", vocab.ANNOTATION_ARMS), "unrecognized arm"),
        (one_of("temporality", vocab.TEMPORALITIES), "unrecognized temporality"),
        (one_of("certainty", vocab.CERTAINTIES), "unrecognized certainty"),
    ]
    return annotations.withColumn("problems", collect_problems(rules))


def contract_problems(rows: DataFrame, contract: T.StructType) -> DataFrame:
    """Rules read off a contract: non-nullable fields are required, an ``enum`` entry in a field's
    metadata lists its values (of each element, for arrays)."""
    rules = []
    for field in contract.fields:
        value = F.col(field.name)
        if not field.nullable:
            rules.append((value.isNull(), f"missing {field.name}"))
        allowed = field.metadata.get("enum") if field.metadata else None
        if allowed and isinstance(field.dataType, T.ArrayType):
            listed = F.array(*map(F.lit, allowed))
            rules.append((F.size(F.array_except(value, listed)) > 0, f"unrecognized {field.name}"))
        elif allowed:
            rules.append((~value.isin(*allowed), f"unrecognized {field.name}"))
    return rows.withColumn("problems", collect_problems(rules))


def bundle_gate(
    syntheses: DataFrame, clusters: DataFrame, cases: DataFrame, classified: DataFrame
) -> DataFrame:
    """Problems that keep a synthesis from being published, as (dossier_id, problem) rows.

    ``clusters`` has (dossier_id, cluster_id, evidence_index), one row per cited claim;
    ``cases`` (dossier_id, side); ``classified`` (dossier_id, evidence_index, current_form_signal,
    current_form_allowed).
    """
    texts = ["popular_take", "counter_case", "what_community_might_be_missing", "key_question"]
    blank = _any([F.trim(F.coalesce(F.col(n), F.lit(""))) == "" for n in texts])
    ids = syntheses.select("dossier_id")
    n_clusters = clusters.groupBy("dossier_id").agg(F.count_distinct("cluster_id").alias("_n"))
    points = cases.groupBy("dossier_id").agg(
        F.count_if(F.col("side") == "a").alias("_a"), F.count_if(F.col("side") == "b").alias("_b")
    )
    cited = clusters.join(
        classified.select("dossier_id", "evidence_index").distinct(),
        ["dossier_id", "evidence_index"], "left_semi",
    )
    unsupported = (
        clusters.select("dossier_id", "cluster_id")
        .distinct()
        .join(cited.select("dossier_id", "cluster_id").distinct(), ["dossier_id", "cluster_id"], "left_anti")
    )
    stale = classified.where(
        F.coalesce("current_form_signal", F.lit(False))
        & ~F.coalesce("current_form_allowed", F.lit(False))
    )
    say = lambda rows, message: rows.select("dossier_id", F.lit(message).alias("problem"))
    few = ids.join(n_clusters, "dossier_id", "left").where(F.coalesce("_n", F.lit(0)) < 3)
    sparse = ids.join(points, "dossier_id", "left").where(
        (F.coalesce("_a", F.lit(0)) < 3) | (F.coalesce("_b", F.lit(0)) < 3)
    )
    return (
        say(syntheses.where(blank), "blank fields")
        .unionByName(say(few, "fewer than 3 evidence clusters"))
        .unionByName(say(sparse, "case points are too sparse"))
        .unionByName(say(unsupported, "clusters without classified evidence"))
        .unionByName(say(stale, "stale evidence marked current form"))
        .distinct()
    )
