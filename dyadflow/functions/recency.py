"""How old a source is and what it may therefore support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dyadflow.functions import vocab
from dyadflow.functions.text import col


BUCKETS = ("current_window", "recent_context", "historical_context", "unknown")


def published_at(text: Column | str) -> Column:
    """ISO timestamp text (``Z`` accepted) to a timestamp; unreadable text is null."""
    return F.try_to_timestamp(F.nullif(F.trim(col(text)), F.lit("")))


def age_days(published: Column | str, as_of: Column) -> Column:
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(published))
    days = F.greatest(F.lit(0).cast("long"), F.floor(micros / F.lit(86_400_000_000)).cast("long"))
    # greatest() skips nulls, an unknown date must stay unknown
    return F.when(col(published).isNotNull(), days)


def bucket(age: Column | str) -> Column:
    age = col(age)
    return (
        F.when(age.isNull(), F.lit("unknown"))
        .when(age <= vocab.CURRENT_WINDOW_DAYS, F.lit("current_window"))
        .when(age <= vocab.RECENT_CONTEXT_DAYS, F.lit("recent_context"))
        .otherwise(F.lit("historical_context"))
    )


def current_form_allowed(recency: Column | str) -> Column:
    return col(recency) == "current_window"


def roles(recency: Column | str) -> Column:
    allowed = F.array(*map(F.lit, ("current_form", "durable_style", "historical_context")))
    other = F.array(*map(F.lit, ("durable_style", "historical_context", "not_current_form")))
    return F.when(current_form_allowed(recency), allowed).otherwise(other)
