"""Text, key and label expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dyadflow.functions import vocab


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


WHITESPACE = " \t\n\v\f\r\u0085\u00a0"


def slugify(value: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(value)), "[^a-z0-9]+", "-"), F.lit("-"))


def base_natural_key(event_slug, name_a, name_b, arm) -> Column:
    """``event:slug:slug:arm`` with the two athlete slugs in sorted order."""
    a, b = slugify(name_a), slugify(name_b)
    return F.concat_ws(":", col(event_slug), F.least(a, b), F.greatest(a, b), col(arm))


def timestamp_seconds(value: Column | str) -> Column:
    """``MM:SS`` or ``HH:MM:SS`` to seconds; anything else is null."""
    text = F.trim(col(value))
    parts = F.split(text, ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    return (
        F.when(text.rlike(r"^\d+:\d+$"), number(1) * 60 + number(2))
        .when(text.rlike(r"^\d+:\d+:\d+$"), number(1) * 3600 + number(2) * 60 + number(3))
        .otherwise(F.lit(None).cast("int"))
    )


def format_seconds(value: Column | str) -> Column:
    seconds = col(value).cast("long")
    hours = F.floor(seconds / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    two = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(
        c.cast("string")
    )
    tail = F.concat(two(minutes), F.lit(":"), two(F.pmod(seconds, F.lit(60))))
    return F.when(hours > 0, F.concat(two(hours), F.lit(":"), tail)).otherwise(tail)


def deep_link(url: Column | str, timestamp: Column | str) -> Column:
    seconds = timestamp_seconds(timestamp)
    return F.when(
        seconds.isNotNull(), F.concat(col(url), F.lit("&t="), seconds.cast("string"), F.lit("s"))
    ).otherwise(col(url))


def iso_duration_seconds(value: Column | str) -> Column:
    """``PT1H2M3S`` with any part missing; 0 when the text is not a duration."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    text = F.coalesce(col(value), F.lit(""))
    part = lambda i: F.coalesce(
        F.regexp_extract(text, pattern, i).try_cast("long"), F.lit(0).cast("long")
    )
    return part(1) * 3600 + part(2) * 60 + part(3)


def alias(value: Column | str, table: Mapping[str, str]) -> Column:
    """Replace a known alias (trimmed, case-insensitive); unknown values stay as they are."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.lower(F.trim(col(value)))), col(value))


def contains_any(text: Column | str, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(col(text), F.lit(needle))
    return found


def kg_values(text: Column | str) -> Column:
    """All weights in a text, single (``82``) or as a range (``80-85``), in text order."""
    pattern = F.lit(r"(?i)\b(?:(?:around|nearly|approximately)\s*)?\d{2,3}(?:\s*-\s*\d{2,3})?\s*kg\b")
    found = F.regexp_extract_all(col(text), pattern, F.lit(0))
    return F.transform(found, lambda m: F.regexp_replace(m, "[^0-9-]", ""))


def replace_context(text: Column | str, table: Mapping[str, str]) -> Column:
    """Phrase replacement, one phrase after the other."""
    result = col(text)
    for phrase, replacement in table.items():
        result = F.replace(result, F.lit(phrase), F.lit(replacement))
    return result


def safe_filename(value: Column | str) -> Column:
    return F.regexp_replace(col(value), r"[^A-Za-z0-9_.-]+", "_")


def dollars(value: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.4f", F.bround(col(value).cast("double"), 4)))


def redact(message: Column | str, secret: Column | str) -> Column:
    """Remove a secret and its URL-escaped form from a message before it is stored."""
    mark = F.lit("[REDACTED]")
    clean = F.replace(col(message), col(secret), mark)
    clean = F.replace(clean, F.url_encode(col(secret)), mark)
    return F.when(col(secret) == "", col(message)).otherwise(clean)


def passed(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(value))) == "pass", F.lit(False))


def nullable_arm(value: Column | str) -> Column:
    return F.when(col(value).isin(*vocab.ARMS), col(value))


def integers_in(text: Column | str) -> Column:
    """Every stand-alone integer in a text."""
    found = F.regexp_extract_all(col(text), F.lit(r"\b(\d+)\b"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def search_plan(name_a: Column | str, name_b: Column | str, arm: Column | str) -> Column:
    """The ten search phrases for one contest, in order."""
    a, b, side = col(name_a), col(name_b), F.concat(col(arm), F.lit(" arm"))
    phrases = [
        [a, b], [a, b, side], [a, b, F.lit("prediction")], [a, b, F.lit("analysis")],
        [a, F.lit("interview"), side], [b, F.lit("interview"), side],
        [a, F.lit("training"), side], [b, F.lit("training"), side],
        [a, F.lit("injury recovery")], [b, F.lit("injury recovery")],
    ]
    return F.array(*[F.concat_ws(" ", *words) for words in phrases])


def canonical(fields: Mapping[str, Column]) -> Column:
    """``name=value`` pairs in sorted name order, the text that payload digests are taken from."""
    parts = []
    for name in sorted(fields):
        parts.append(
            F.concat(F.lit(f"{name}="), F.coalesce(fields[name].cast("string"), F.lit("null")))
        )
    return F.concat_ws("|", *parts)
