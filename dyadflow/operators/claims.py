"""Claims: union, first-seen dedupe, recency, dimensions, deterministic enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.functions import recency, text, vocab
from dyadflow.operators.running import ordinal

CLAIM_KEY = ("video_id", "timestamp", "claim")
BASELINE_MODEL = "gemini-2.5-flash-baseline"


def union_datasets(datasets: Sequence[DataFrame]) -> DataFrame:
    """Stack evidence datasets, remembering which file each claim came from."""
    tagged = [d.withColumn("file_ord", F.lit(i)) for i, d in enumerate(datasets)]
    result = tagged[0]
    for more in tagged[1:]:
        result = result.unionByName(more, allowMissingColumns=True)
    return result


def dedupe_claims(
    claims: DataFrame,
    dossier: Sequence[str] = (),
    key: Sequence[str] = CLAIM_KEY,
    order: Sequence[str] = ("file_ord", "pos"),
    max_rows_per_task: int | None = None,
) -> DataFrame:
    """Keep the first claim of each key and number what is left from 0 in input order.

    Grouping is null-safe (two missing timestamps are the same timestamp), and the first row is
    found by a top-1 that runs before the shuffle as well, so a text copied a billion times does
    not meet in one task.
    """
    first = Window.partitionBy(*dossier, *key).orderBy(*order)
    kept = claims.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return ordinal(kept, list(dossier), list(order), "evidence_index", max_rows_per_task)


def normalize_claims(claims: DataFrame, as_of: Column) -> DataFrame:
    """Defaults, deep link and recency columns of raw claims joined to their video.

    Input: video_id, video_title, channel, url, published_at (text), timestamp, claim,
    speaker_or_source, relevance, confidence, selected_model.
    """
    or_ = lambda n, d: F.coalesce(F.col(n), F.lit(d)).alias(n)
    stamp = F.coalesce("timestamp", F.lit(""))
    return (
        claims.withColumn("_age", recency.age_days(recency.published_at("published_at"), as_of))
        .withColumn("source_recency", recency.bucket("_age"))
        .select(
            "video_id", "video_title", "channel", or_("claim", ""), stamp.alias("timestamp"),
            text.deep_link("url", stamp).alias("source_url"),
            or_("speaker_or_source", "unknown"), or_("relevance", ""), or_("confidence", "unknown"),
            F.col("published_at").alias("source_published_at"),
            F.col("_age").alias("source_age_days"),
            "source_recency",
            recency.current_form_allowed("source_recency").alias("current_form_allowed"),
            recency.roles("source_recency").alias("allowed_evidence_roles"),
            "selected_model",
        )
    )


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of ``right`` win where it has a value; the rest of ``left`` stays."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    renamed = right.select(key, *[F.col(c).alias(f"_o_{c}") if c in shared else F.col(c) for c in right.columns if c != key])
    joined = left.join(renamed, key, "left")
    for c in shared:
        joined = joined.withColumn(c, F.coalesce(f"_o_{c}", c)).drop(f"_o_{c}")
    return joined


def best_result(results: DataFrame, preference: Sequence[str]) -> DataFrame:
    """Per video the first passing model in order of preference, else the baseline.

    ``results`` is (video_id, model, pass_fail, ...).
    """
    rank = F.lit(len(preference))
    for i, model in reversed(list(enumerate(preference))):
        rank = F.when(F.col("model") == model, F.lit(i)).otherwise(rank)
    usable = results.withColumn("_rank", rank).where(
        (F.col("model") == BASELINE_MODEL)
        | ((F.col("_rank") < len(preference)) & text.passed("pass_fail"))
    )
    best = Window.partitionBy("video_id").orderBy("_rank", "model")
    return (
        usable.withColumn("_r", F.row_number().over(best))
        .where("_r = 1")
        .withColumn(
            "model_selection_reason",
            F.when(F.col("_rank") < len(preference), "cheaper_candidate_passed").otherwise(
                "baseline_fallback"
            ),
        )
        .drop("_r", "_rank")
    )


def fallback_result(primary: DataFrame, fallback: DataFrame, min_score: int = 30) -> DataFrame:
    """Use the fallback model where the primary failed, the source scores high and it passed.

    Both sides are (video_id, model, pass_fail, media_cost, eval_cost, claim_count); ``primary``
    also has score. Claims of a source that does not pass in the end are not retained.
    """
    cols = ["model", "pass_fail", "media_cost", "eval_cost", "claim_count"]
    other = fallback.select("video_id", *[F.col(c).alias(f"_f_{c}") for c in cols])
    use = (
        ~text.passed("pass_fail")
        & (F.coalesce("score", F.lit(0)) >= min_score)
        & text.passed("_f_pass_fail")
    )
    chosen = primary.join(other, "video_id", "left").withColumn("_use", F.coalesce(use, F.lit(False)))
    picked = chosen.select(
        "video_id", "score",
        *[F.when(F.col("_use"), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
    )
    ok = text.passed("pass_fail")
    return picked.withColumn("passed", ok).withColumn(
        "claim_count", F.when(ok, F.col("claim_count")).otherwise(0)
    )


def evaluation_totals(sources: DataFrame) -> DataFrame:
    """Sources seen and passed, claims retained, cost of both stages."""
    return sources.agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if("passed").alias("passed_source_count"),
        F.sum("claim_count").alias("claims_retained"),
        F.sum("media_cost").alias("media_cost"),
        F.sum("eval_cost").alias("eval_cost"),
    )


def candidate_grid(sources: DataFrame, models: DataFrame, candidates: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Candidate results with their evaluation, for the requested models of the listed sources."""
    return (
        candidates.join(sources.select("video_id"), "video_id", "left_semi")
        .join(models.select("model"), "model", "left_semi")
        .join(evaluations, ["video_id", "model"])
    )


# ------------------------------------------------------------------ dimensions and atoms


def batch_index(index: Column | str, size: int) -> Column:
    return (F.floor(text.col(index) / size) + 1).cast("long")


def normalize_dimensions(items: DataFrame, claims: DataFrame, keep_supplied: bool = True) -> DataFrame:
    """Model-written dimensions of claims: aliases, defaults, recency rule, deterministic values.

    Items of unknown claims are dropped. ``keep_supplied=False`` keeps only the measurements
    found in the text.
    """
    facts = claims.select(
        "evidence_index", F.col("claim").alias("_claim"), F.col("relevance").alias("_relevance"),
        F.coalesce("current_form_allowed", F.lit(False)).alias("_current"),
        F.col("allowed_evidence_roles").alias("_roles"),
    )
    strings = F.array().cast("array<string>")
    has_role = lambda r: F.coalesce(F.array_contains("_roles", r), F.lit(False))
    scope = F.coalesce(text.alias("temporal_scope", vocab.TEMPORAL_ALIASES), F.lit("unclear"))
    stale_scope = F.when(~F.col("_current") & (scope == "current_form"), "historical_event").otherwise(scope)
    joined = items.join(facts, "evidence_index")
    supplied = F.coalesce("measurements", strings_like(items, "measurements"))
    base = joined.select(
        "evidence_index",
        F.coalesce(text.alias("evidence_kind", vocab.EVIDENCE_KIND_ALIASES), F.lit("unclear")).alias("_kind"),
        stale_scope.alias("temporal_scope"),
        F.coalesce("arm_side", F.lit("unknown")).alias("arm_side"),
        *[F.coalesce(c, strings).alias(c) for c in ("mechanics", "table_positions", "physical_attributes")],
        (supplied if keep_supplied else strings_like(items, "measurements")).alias("_measurements"),
        F.coalesce("lifts", strings_like(items, "lifts")).alias("_lifts"),
        (F.col("_current") & F.coalesce("current_form_usable", F.lit(False))).alias("current_form_usable"),
        F.coalesce("durable_style_usable", has_role("durable_style")).alias("durable_style_usable"),
        F.coalesce("historical_context_usable", has_role("historical_context")).alias(
            "historical_context_usable"
        ),
        F.coalesce("noise_risk", F.lit("medium")).alias("noise_risk"),
        F.coalesce("dimension_confidence", F.lit("medium")).alias("dimension_confidence"),
        F.lower(F.concat_ws(" ", F.coalesce("_claim", F.lit("")), F.coalesce("_relevance", F.lit("")))).alias("_text"),
    )
    found = with_text_values(base)
    return found.select(
        *[c for c in base.columns if not c.startswith("_")],
        F.array_distinct(F.concat("_measurements", "text_measurements")).alias("measurements"),
        F.array_distinct(F.concat("_lifts", "text_lifts")).alias("lifts"),
        promoted_kind("_kind").alias("evidence_kind"),
    )


def strings_like(items: DataFrame, name: str) -> Column:
    return F.array().cast(items.schema[name].dataType)


def with_text_values(rows: DataFrame, text_column: str = "_text") -> DataFrame:
    """Append body weights and lifts read from lower-case text, as ``name=value`` strings."""
    lower = F.col(text_column)
    values = rows.withColumn("kg_values", F.array_distinct(text.kg_values(lower)))
    weight = text.contains_any(lower, vocab.BODY_WEIGHT_PHRASES)
    labelled = lambda name: F.transform("kg_values", lambda v: F.concat(F.lit(f"{name}="), v))
    none = F.array().cast("array<string>")
    lifts = F.array_distinct(
        F.flatten(
            F.array(*[
                F.when(F.contains(lower, F.lit(keyword)), labelled(lift)).otherwise(none)
                for keyword, lift in vocab.LIFT_KEYWORDS.items()
            ])
        )
    )
    return values.withColumn(
        "text_measurements", F.when(weight, labelled("body_weight")).otherwise(none)
    ).withColumn("text_lifts", lifts)


#: Fixed values of nested dimensions: the fields of each, their defaults, and what a value that is no
#: object becomes (``None``: the value itself).
UNSTRUCTURED = "Converted from unstructured model output."
NESTED = {
    "measurements": (
        {"metric": "unknown", "value": "", "unit": "", "setup_or_context": "", "confidence": "medium", "caveat": ""},
        {"metric": None, "confidence": "low", "caveat": UNSTRUCTURED},
    ),
    "lifts": (
        {"lift_name": "", "value": "", "unit": "", "setup_details_visible": False, "maps_to_table_action": "",
         "comparability_caveat": "", "confidence": "medium"},
        {"lift_name": None, "confidence": "low", "comparability_caveat": UNSTRUCTURED},
    ),
    "transferable_lessons": (
        {"referenced_opponent_or_match": "", "tested_property": "", "transfers_how": "",
         "transfer_strength": "medium", "caveat": ""},
        {"referenced_opponent_or_match": None, "transfer_strength": "low", "caveat": UNSTRUCTURED},
    ),
}
BODY_WEIGHT_CAVEAT = (
    "Source claim may be self-report or commentary; verify against official weigh-in where possible."
)
LIFT_CAVEAT = "Extracted from claim text only; setup/handle/body position not standardized."


def _kind_of(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "string"


def nested(name: str, elements: Column | str) -> Column:
    """JSON elements to structs of one dimension: objects get defaults, anything else is converted."""
    defaults, loose = NESTED[name]
    other_names = {"metric": ("type", "name")} if name == "measurements" else {}
    fields = {**{f: _kind_of(v) for f, v in defaults.items()}, **{o: "string" for n in other_names.values() for o in n}}
    schema = "struct<" + ",".join(f"{f}:{k}" for f, k in fields.items()) + ">"
    names = [n for n in defaults]

    def one(element: Column) -> Column:
        parsed = F.from_json(element, schema)
        whole = F.struct(*[
            F.coalesce(parsed[f], *[parsed[o] for o in other_names.get(f, ())], F.lit(defaults[f])).alias(f)
            for f in names
        ])
        converted = F.struct(*[
            (element if f in loose and loose[f] is None else F.lit(loose.get(f, False if _kind_of(defaults[f]) == "boolean" else ""))).alias(f)
            for f in names
        ])
        is_object = F.startswith(F.ltrim(element), F.lit("{")) & F.try_parse_json(element).isNotNull()
        return F.when(is_object, whole).otherwise(converted)

    shape = "array<struct<" + ",".join(f"{f}:{_kind_of(v)}" for f, v in defaults.items()) + ">>"
    made = F.transform(F.filter(text.col(elements), lambda e: e.isNotNull()), one)
    return F.coalesce(made, F.array()).cast(shape)


def nested_dimensions(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Measurements, lifts and lessons of claims as arrays of structs, with what the claim's text states.

    ``items`` holds them as arrays of JSON elements; null elements are dropped, missing lists are empty.
    A weight of the text is added unless the item has that metric or lift with that value already.
    """
    facts = claims.select(
        "evidence_index",
        F.lower(F.concat_ws(" ", F.coalesce("claim", F.lit("")), F.coalesce("relevance", F.lit("")))).alias("_text"),
    )
    rows = items.select("evidence_index", "evidence_kind", *NESTED).join(facts, "evidence_index")
    rows = rows.withColumns({n: nested(n, n) for n in NESTED}).withColumn("_kg", F.array_distinct(text.kg_values("_text")))
    lower = F.col("_text")
    weighs, some = text.contains_any(lower, vocab.BODY_WEIGHT_PHRASES), F.size("_kg") > 0

    def absent(have: str, name: str, what: str, value: Column) -> Column:
        return ~F.exists(have, lambda h: (h[name] == F.lit(what)) & (h["value"] == value))

    def measured(v: Column) -> Column:
        own = {"metric": F.lit("body_weight"), "value": v, "unit": F.lit("kg"),
               "setup_or_context": F.lit("Extracted from claim text."), "confidence": F.lit("medium"),
               "caveat": F.lit(BODY_WEIGHT_CAVEAT)}
        return F.struct(*[c.alias(f) for f, c in own.items()])

    new = F.filter("_kg", lambda v: absent("measurements", "metric", "body_weight", v))
    measurements = F.when(weighs, F.concat("measurements", F.transform(new, measured))).otherwise(F.col("measurements"))
    # two keywords may stand for one lift; the first that occurs states it
    first: dict[str, list[str]] = {}
    for keyword, lift in vocab.LIFT_KEYWORDS.items():
        first.setdefault(lift, []).append(keyword)
    def stated(lift: str, keywords: list[str]) -> Column:
        action = F.coalesce(*[F.when(F.contains(lower, F.lit(k)), F.lit(k)) for k in keywords])
        fresh = F.filter("_kg", lambda v: absent("lifts", "lift_name", lift, v))
        lifted = F.transform(fresh, lambda v: F.struct(
            F.lit(lift).alias("lift_name"), v.alias("value"), F.lit("kg").alias("unit"),
            F.lit(False).alias("setup_details_visible"), action.alias("maps_to_table_action"),
            F.lit(LIFT_CAVEAT).alias("comparability_caveat"), F.lit("low").alias("confidence"),
        ))
        return F.when(action.isNotNull(), lifted).otherwise(F.slice("lifts", 1, 0))

    added = [stated(lift, keywords) for lift, keywords in first.items()]
    lifted_any = text.contains_any(lower, list(vocab.LIFT_KEYWORDS))
    kind = F.coalesce(text.alias("evidence_kind", vocab.EVIDENCE_KIND_ALIASES), F.lit("unclear"))
    unclear = (kind == "unclear") & some
    return rows.select(
        "evidence_index",
        F.when(unclear & weighs, "measurement").when(unclear & lifted_any, "gym_lift_proxy").otherwise(kind).alias("evidence_kind"),
        measurements.alias("measurements"), F.concat("lifts", *added).alias("lifts"), "transferable_lessons",
    )


def promoted_kind(kind: Column | str) -> Column:
    """An unclear kind becomes what the text values show, weights before lifts."""
    unclear = text.col(kind) == "unclear"
    return (
        F.when(unclear & (F.size("text_measurements") > 0), "measurement")
        .when(unclear & (F.size("text_lifts") > 0), "gym_lift_proxy")
        .otherwise(text.col(kind))
    )


def normalize_atoms(responses: DataFrame, claims: DataFrame) -> DataFrame:
    """Atoms of model responses: ids from claim and position, aliases, defaults, recency rule.

    ``responses`` is (batch, atoms array of struct); an atom whose claim is not part of its own
    batch is dropped.
    """
    facts = claims.select(
        "evidence_index", batch_index("evidence_index", vocab.ATOM_BATCH).alias("batch"),
        F.coalesce("current_form_allowed", F.lit(False)).alias("_current"),
        F.col("allowed_evidence_roles").alias("_roles"),
    )
    has_role = lambda r: F.coalesce(F.array_contains("_roles", r), F.lit(False))
    strings = F.array().cast("array<string>")
    atoms = responses.select("batch", F.posexplode("atoms").alias("_pos", "a")).select(
        "batch", "_pos", "a.*"
    )
    return atoms.join(facts, ["batch", "evidence_index"]).select(
        F.concat_ws("_", F.concat(F.lit("a"), F.col("evidence_index").cast("string")), (F.col("_pos") + 1).cast("string")).alias("atom_id"),
        "evidence_index",
        *[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("actor", "action")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("lane", "position_state")],
        *[F.coalesce(c, strings).alias(c) for c in ("enables", "denies")],
        F.coalesce(text.alias("source_basis", vocab.SOURCE_BASIS_ALIASES), F.lit("unclear")).alias("source_basis"),
        F.coalesce("confidence", F.lit("medium")).alias("confidence"),
        (F.col("_current") & F.coalesce("current_form_usable", F.lit(False))).alias("current_form_usable"),
        F.coalesce("durable_style_usable", has_role("durable_style")).alias("durable_style_usable"),
        F.coalesce("historical_context_usable", has_role("historical_context")).alias("historical_context_usable"),
    )


def enforce_recency_on_refs(refs: DataFrame, claims: DataFrame) -> DataFrame:
    """Theme references to sources outside the current window may not support current form."""
    allowed = claims.select("evidence_index", F.col("current_form_allowed").alias("_current"))
    stale = F.col("_current").isNotNull() & ~F.col("_current")
    return (
        refs.join(allowed, "evidence_index", "left")
        .withColumn(
            "supports_current_form",
            F.when(stale, F.lit(False)).otherwise(F.col("supports_current_form")),
        )
        .withColumn(
            "caveat",
            F.when(
                stale & (F.coalesce("caveat", F.lit("")) == ""),
                "Source is outside the current-form window.",
            ).otherwise(F.col("caveat")),
        )
        .drop("_current")
    )


def classify_recency(classified: DataFrame, claims: DataFrame) -> DataFrame:
    """Aliases and recency rule of classified claims (claim_type, recency, current_form_signal)."""
    allowed = claims.select("evidence_index", F.coalesce("current_form_allowed", F.lit(False)).alias("_current"))
    return (
        classified.join(allowed, "evidence_index")
        .withColumn("claim_type", text.alias("claim_type", vocab.CLAIM_TYPE_ALIASES))
        .withColumn("current_form_signal", F.col("_current") & F.coalesce("current_form_signal", F.lit(False)))
        .withColumn(
            "recency",
            F.when(~F.col("_current") & (F.col("recency") == "current"), "old_context").otherwise(
                F.col("recency")
            ),
        )
        .drop("_current")
    )


def refs_from_summary(summaries: DataFrame) -> DataFrame:
    """References hidden in summary text: one row per integer, in order."""
    return summaries.select(
        "theme_id", "summary", F.posexplode(text.integers_in("summary")).alias("pos", "evidence_index")
    ).select(
        "theme_id", "pos", "evidence_index",
        F.lit("Referenced by model summary").alias("role_in_theme"),
        F.col("summary").alias("quote_level_summary"),
        F.lit(False).alias("supports_current_form"),
        F.lit(False).alias("supports_durable_style"),
        F.lit(False).alias("supports_historical_context"),
        F.lit("Converted from summary string; inspect source claim before relying on it.").alias("caveat"),
    )


def high_signal(dimensions: DataFrame, limit: int = 30) -> DataFrame:
    """Most informative dimensions: low noise, high confidence, many values."""
    filled = F.size("mechanics") + F.size("measurements") + F.size("lifts")
    return dimensions.orderBy(
        F.desc(F.col("noise_risk") == "low"),
        F.desc(F.col("dimension_confidence") == "high"),
        F.desc(filled),
        "evidence_index",
    ).limit(limit)


# ------------------------------------------------------------------ annotation


def resolve_subjects(annotations: DataFrame, competitors: DataFrame) -> DataFrame:
    """Athlete id of a free-text subject; a name that is no competitor of the match gives null."""
    names = competitors.select(
        "match_id", F.col("name").alias("subject_athlete_name"),
        F.col("athlete_id").alias("subject_athlete_id"),
    )
    return annotations.join(names, ["match_id", "subject_athlete_name"], "left").withColumn(
        "arm", text.nullable_arm("arm")
    )


ANNOTATION_SCHEMA = (
    "claim_id long, claim_type string, concepts array<string>, subject_athlete_name string, "
    "arm string, temporality string, certainty string"
)


def annotate(claims: DataFrame, annotator=None) -> DataFrame:
    """Annotate claims (claim_id, claim_text) with a function from one pandas batch to another.

    ``annotator`` gets and returns pandas frames with the columns of ``ANNOTATION_SCHEMA``; without
    one a keyword rule stands in. Batches are spread over the cluster.
    """
    if annotator is None:
        return _annotate_by_rule(claims)

    def run(batches):
        for batch in batches:
            yield annotator(batch)

    return claims.select("claim_id", "claim_text").mapInPandas(run, ANNOTATION_SCHEMA)


def _annotate_by_rule(claims: DataFrame) -> DataFrame:
    lower = F.lower("claim_text")
    kind = (
        F.when(text.contains_any(lower, ["injur", "error"]), "injury")
        .when(text.contains_any(lower, ["grip", "hook", "press", "click"]), "tactic")
        .when(text.contains_any(lower, ["start", "setup", "signup"]), "setup")
        .when(text.contains_any(lower, ["form", "view"]), "form")
        .otherwise("other")
    )
    concept = (
        F.when(kind == "injury", "injury_or_recovery_status")
        .when(kind == "tactic", "hook")
        .when(kind == "setup", "start_position")
        .otherwise("training_regimen")
    )
    return claims.select(
        "claim_id", kind.alias("claim_type"), F.array(concept).alias("concepts"),
        F.lit("").alias("subject_athlete_name"), F.lit("unclear").alias("arm"),
        F.lit("unclear").alias("temporality"), F.lit("unclear").alias("certainty"),
    )


# ------------------------------------------------------------------ submissions


def extraction_submissions(extractions: DataFrame) -> DataFrame:
    """Keys and status of an extraction's submission; a failed one gets its own batch key.

    Input: video_id, title, url, published_at, match_natural_key, model, matched_queries,
    extracted_at, error_message (null when completed).
    """
    key = F.concat_ws(
        ":", F.lit(vocab.EXTRACTION_PROVIDER), "video_id", "model", F.lit(vocab.EXTRACTION_SCHEMA_VERSION)
    )
    failed = F.col("error_message").isNotNull()
    return extractions.select(
        F.lit(vocab.EVIDENCE_SCHEMA_VERSION).alias("schema_version"),
        F.when(failed, F.concat(key, F.lit(":failed"))).otherwise(key).alias("batch_key"),
        "match_natural_key",
        F.concat(F.lit("youtube:"), "video_id").alias("source_key"),
        F.lit("youtube").alias("source_type"),
        F.col("video_id").alias("external_id"), "url", "title", "published_at", "matched_queries",
        key.alias("extraction_key"), F.lit(vocab.EXTRACTION_PROVIDER).alias("provider"), "model",
        F.lit(vocab.EXTRACTION_SCHEMA_VERSION).alias("prompt_version"),
        F.when(failed, "failed").otherwise("completed").alias("status"), "extracted_at", "error_message",
    )


def ingestion_summary(claims: DataFrame, by: Sequence[str] = ("batch_key",)) -> DataFrame:
    """Sources and claims that each batch brought; a source counts once however many claims it has."""
    per_source = claims.groupBy(*by, "source_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_source.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sources"), F.sum("_n").alias("claims")
    )


def not_yet_extracted(candidates: DataFrame, extractions: DataFrame) -> DataFrame:
    """Candidates without a completed extraction for the same match, source, provider, model and
    prompt version."""
    keys = ["match_natural_key", "source_type", "external_id", "provider", "model", "prompt_version"]
    done = extractions.where(F.col("status") == "completed").select(*keys)
    return candidates.join(done, keys, "left_anti")
