"""Finding and ranking sources, what they would cost, and what located windows cover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.functions import text, vocab
from dyadflow.operators.running import ordinal, running_before


@dataclass(frozen=True)
class Seeds:
    """A scoring configuration: a handful of names and phrases."""

    trusted_channels: Mapping[str, int]
    positive_terms: Sequence[str]
    negative_terms: Sequence[str]
    targets: tuple[str, str]


def score_sources(rows: DataFrame, seeds: Seeds) -> DataFrame:
    """Append ``score`` and ``score_reasons`` (title, description, channel, caption, view_count)."""
    lower = lambda n: F.lower(F.coalesce(n, F.lit("")))
    prepared = rows.withColumn("_channel", lower("channel")).withColumn(
        "_combined", F.concat_ws(" ", lower("title"), lower("description"))
    )
    has = lambda needle: F.contains(F.col("_combined"), F.lit(needle))
    first, second = (has(t) for t in seeds.targets)
    hits = [
        (F.contains(F.col("_channel"), F.lit(name.lower())), 3 * priority, f"trusted channel: {name}")
        for name, priority in seeds.trusted_channels.items()
    ]
    hits += [(has(t), 2, f"matched term: {t}") for t in seeds.positive_terms]
    hits += [
        (first & second, 10, "mentions both targets"),
        ((first | second) & ~(first & second), 3, "mentions one target athlete"),
    ]
    hits += [(has(t), -4, f"negative term: {t}") for t in seeds.negative_terms]
    hits += [
        (F.coalesce(F.col("caption") == "true", F.lit(False)), 1, "caption flag true"),
        (F.coalesce(F.col("view_count") > 10_000, F.lit(False)), 1, "10k+ views"),
    ]
    # each test runs once; points and reason travel together
    found = F.array(
        *[F.when(h, F.struct(F.lit(p).alias("points"), F.lit(r).alias("reason"))) for h, p, r in hits]
    )
    scored = prepared.select(*rows.columns, F.array_compact(found).alias("_hits"))
    return scored.select(
        *rows.columns,
        F.aggregate("_hits", F.lit(0), lambda total, h: total + h["points"]).alias("score"),
        F.col("_hits")["reason"].alias("score_reasons"),
    )


def rank_sources(scored: DataFrame, max_rows_per_task: int | None = None) -> DataFrame:
    """Dense ``rank`` from 0 by score and views, both descending; ties in order of id."""
    return ordinal(
        scored.withColumn("_s", -F.col("score")).withColumn("_v", -F.coalesce("view_count", F.lit(0))),
        [], ["_s", "_v", "id"], "rank", max_rows_per_task,
    ).drop("_s", "_v")


def classify_sources(rows: DataFrame, targets: tuple[str, str], style_phrase: str) -> DataFrame:
    """Category, exclusion flag and reasons. A later rule replaces the category; the flag stays."""
    lower = lambda n: F.lower(F.coalesce(n, F.lit("")))
    prepared = rows.withColumn(
        "_text", F.concat_ws(" ", lower("title"), lower("description"))
    ).withColumn("duration_seconds", text.iso_duration_seconds("duration"))
    has = lambda *terms: text.contains_any("_text", terms)
    flagged = prepared.withColumns(
        {
            "_short": (F.col("duration_seconds") <= 45) & has("stage walk", "walkout", "edit", "short"),
            "_cancelled": has("cancelled", "canceled"),
            "_direct": has(targets[0]) & has(targets[1]),
            "_style": has(style_phrase) & ~has(targets[1]),
            "_language": has("prediction", "predict", "analysis", "breakdown"),
            "_right": has("right hand", "right arm"),
        }
    )
    short, cancelled, direct = F.col("_short"), F.col("_cancelled"), F.col("_direct")
    style = ~direct & F.col("_style")
    reasons = F.array_compact(
        F.array(
            F.when(short, F.lit("very short stage-walk/edit/short-style video")),
            F.when(cancelled, F.lit("cancellation/replacement news")),
            F.when(direct, F.lit("mentions both target athletes")),
            F.when(style, F.lit("style context, not the direct matchup")),
            F.when(F.col("_language"), F.lit("analysis/prediction language")),
            F.when(F.col("_right"), F.lit("right-hand/right-arm signal")),
            F.when(F.col("duration_seconds") >= 600, F.lit("long-form or match-length source")),
        )
    )
    category = (
        F.when(direct, "direct_or_near_direct")
        .when(style, "style_evidence")
        .when(cancelled, "exclude_cancellation_context")
        .when(short, "exclude_low_signal_short")
        .otherwise("review")
    )
    none = F.array(F.lit("ambiguous; keep for review"))
    return flagged.select(
        *rows.columns, "duration_seconds", category.alias("filter_category"),
        (short | cancelled).alias("exclude_high_confidence"),
        F.when(F.size(reasons) == 0, none).otherwise(reasons).alias("filter_reasons"),
    )


def kept_sources(classified: DataFrame, limit: int = 40) -> DataFrame:
    """First kept sources in rank order."""
    return classified.where(~F.col("exclude_high_confidence")).orderBy("rank").limit(limit)


def scope_costs(classified: DataFrame, tops: Sequence[int] = (20, 40)) -> DataFrame:
    """Hours and cost of the top, all and kept sources. A source counts in every scope it is in."""
    scopes = [F.when(F.col("rank") < n, F.lit(f"top {n}")) for n in tops]
    scopes += [F.lit("all"), F.when(~F.col("exclude_high_confidence"), F.lit("kept"))]
    spread = classified.select(
        "duration_seconds", F.explode(F.array_compact(F.array(*scopes))).alias("scope")
    )
    hours = F.sum("duration_seconds") / 3600
    return spread.groupBy("scope").agg(
        F.count(F.lit(1)).alias("videos"),
        hours.alias("hours"),
        *[(hours * price).alias(f"{name}_cost") for name, price in vocab.HOURLY_PRICES.items()],
        (F.count(F.lit(1)) * vocab.EVAL_PRICE_LOW).alias("eval_cost_low"),
        (F.count(F.lit(1)) * vocab.EVAL_PRICE_HIGH).alias("eval_cost_high"),
    )


def matched_queries(candidates: DataFrame) -> DataFrame:
    """Distinct queries that found each candidate, in first-seen order.

    Rows are first reduced to one per candidate and query, so the list is never longer than the
    search plan however often a candidate was found.
    """
    once = candidates.groupBy("id", "query").agg(F.min("seq").alias("_seq"))
    return once.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("_seq", "query"))).getField("query").alias("matched_queries")
    )


def interleave(candidates: DataFrame, maximum: int) -> DataFrame:
    """Round-robin over ranked lists (id, list_ord, rank), each id once, at most ``maximum`` ids.

    An id's turn is its smallest (rank, list) pair, which an aggregation finds without walking the
    lists.
    """
    if maximum <= 0:
        return candidates.select("id", F.lit(0).alias("rank"), F.lit(0).alias("list_ord")).limit(0)
    turn = (
        candidates.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
        .groupBy("id")
        .agg(F.min(F.struct("rank", "list_ord")).alias("_t"))
    )
    return turn.select("id", "_t.rank", "_t.list_ord").orderBy("rank", "list_ord").limit(maximum)


# ------------------------------------------------------------------ windows


def normalize_windows(windows: DataFrame) -> DataFrame:
    """First four windows per source, unreadable or empty ones dropped, long ones cut.

    ``windows`` is (source_id, pos from 0, start, end) with time texts.
    """
    timed = windows.where(F.col("pos") < vocab.MAX_WINDOWS).select(
        "source_id", "pos",
        text.timestamp_seconds("start").alias("start_seconds"),
        text.timestamp_seconds("end").alias("_end"),
    )
    return timed.where("_end > start_seconds").select(
        "source_id", "pos", "start_seconds",
        F.least("_end", F.col("start_seconds") + vocab.MAX_WINDOW_SECONDS).alias("end_seconds"),
    )


def covered_claims(
    claims: DataFrame, windows: DataFrame, max_rows_per_task: int | None = None
) -> DataFrame:
    """Append ``covered``: does any window of the claim's source contain its time?

    A claim is inside some window exactly when the latest end among the windows that have started
    by then is not before it. One running maximum per source answers that without pairing claims
    and windows. ``claims`` is (source_id, claim_id, seconds), unread times count as missed.
    """
    starts = windows.groupBy("source_id", F.col("start_seconds").cast("long").alias("_t")).agg(
        F.max(F.col("end_seconds").cast("long")).alias("_end")
    )
    none = F.lit(None).cast("long")
    line = starts.select(
        "source_id", "_t", F.lit(0).alias("_kind"), none.alias("claim_id"), "_end"
    ).unionByName(
        claims.where("seconds IS NOT NULL").select(
            "source_id", F.col("seconds").cast("long").alias("_t"), F.lit(1).alias("_kind"),
            F.col("claim_id").cast("long").alias("claim_id"), none.alias("_end"),
        )
    )
    reached = running_before(
        line, ["source_id"], ["_t", "_kind", "claim_id"],
        maxes={"_reach": "_end"},
        max_rows_per_task=max_rows_per_task,
    ).where("_kind = 1")
    inside = reached.select(
        "source_id", "claim_id", F.coalesce(F.col("_reach") >= F.col("_t"), F.lit(False)).alias("covered")
    )
    return claims.join(inside, ["source_id", "claim_id"], "left").fillna({"covered": False})


def coverage_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("baseline_claims"),
        F.count_if("covered").alias("covered_claims"),
        F.count_if(~F.col("covered")).alias("missed_claims"),
    )


# ------------------------------------------------------------------ model cost


def media_cost(details: Column | str, output_tokens: Column | str) -> Column:
    """Cost of one media call from its token counts by modality (array of struct)."""
    prices = F.create_map(*[F.lit(x) for p in vocab.MEDIA_TOKEN_PRICE.items() for x in p])
    zero = F.lit(0.0)
    tokens = F.aggregate(
        F.coalesce(text.col(details), F.array().cast("array<struct<modality:string,tokenCount:bigint>>")),
        zero,
        lambda acc, d: acc
        + F.coalesce(d["tokenCount"].cast("double"), zero)
        * F.coalesce(F.try_element_at(prices, d["modality"]), zero),
    )
    out = F.coalesce(text.col(output_tokens).cast("double"), zero) * vocab.MEDIA_OUTPUT_PRICE
    return (tokens + out) / 1_000_000


def text_cost(prompt_tokens: Column | str, completion_tokens: Column | str) -> Column:
    zero = F.lit(0)
    return (
        F.coalesce(text.col(prompt_tokens), zero) * vocab.TEXT_INPUT_PRICE
        + F.coalesce(text.col(completion_tokens), zero) * vocab.TEXT_OUTPUT_PRICE
    ) / 1_000_000


def two_stage_cost(baseline: DataFrame, locator: DataFrame, extractions: DataFrame) -> DataFrame:
    """Per source: cost of locating plus extracting windows, against the full pass.

    All inputs are (source_id, cost, tokens, claims).
    """
    total = lambda df, p: df.groupBy("source_id").agg(
        F.sum("cost").alias(f"{p}_cost"), F.sum("tokens").alias(f"{p}_tokens"),
        F.sum("claims").alias(f"{p}_claims"), F.count(F.lit(1)).alias(f"{p}_calls"),
    )
    joined = (
        total(baseline, "baseline")
        .join(total(locator, "locator"), "source_id", "left")
        .join(total(extractions, "window"), "source_id", "left")
        .fillna(0)
    )
    located = F.col("locator_cost") + F.col("window_cost")
    return joined.select(
        "source_id", "baseline_claims", "baseline_cost",
        F.col("window_calls").alias("windows"), "window_claims",
        located.alias("located_cost"),
        (F.col("locator_tokens") + F.col("window_tokens")).alias("located_tokens"),
        (located - F.col("baseline_cost")).alias("cost_delta"),
    )
