"""Positions of pattern matches as columns: SQL functions give the matched strings, not where they are.

A text splits at its matches into one piece more than there are matches, found by the same scan, so
the lengths of pieces and matches add up to the positions. Lengths count code points.

Whatever runs along an array goes in blocks, since an array grown element by element is copied each
time, and what is cut out of a text comes from short parts of it, since a substring is counted from the
text's first character. So time is linear in text and spans, but for one copied element a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"
BLOCK = 256  # elements that are carried along at a time
PART = 512  # code points of a part of a text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def between(values: Column, first: Column, last: Column) -> Column:
    """The elements from ``first`` to ``last`` (from 0), read one by one: ``slice`` goes through the whole array."""
    return F.transform(F.sequence(first, last), lambda i: F.get(values, i))


def carried(
    values: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str
) -> Column:
    """Array of what ``step(state, value)`` gives second for each value; what it gives first is the next state."""
    none = F.array().cast(f"array<{kind}>")

    def run(own: Column) -> Column:
        def one(state: Column, value: Column) -> Column:
            at, out = step(state["at"], value)
            return F.struct(at.alias("at"), F.concat(state["out"], F.array(out)).alias("out"))

        def block(state: Column, number: Column) -> Column:
            last = F.least(number * BLOCK + BLOCK, F.size(own)) - 1
            part = between(own, number * BLOCK, last)
            inner = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), one)
            return let(
                inner,
                lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")),
            )

        numbers = F.sequence(F.lit(0), ((F.size(own) - 1) / BLOCK).cast("int"))
        first = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        blocks = F.aggregate(numbers, first, block, lambda state: state["out"])
        return F.when(F.size(own) > 0, F.flatten(blocks)).otherwise(none)

    return let(values, run)


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, as strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def located(text: Column, hits: Column, pattern: str) -> Column:
    """Matches with start and end (exclusive); ``hits`` is ``found(text, pattern)``."""
    pieces = F.split(text, pattern, -1)

    def add(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + F.length(pair["piece"])
        end = begin + F.length(pair["hit"])
        return end, F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit"))

    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit"))
    kind = SPAN.removeprefix("array<").removesuffix(">")
    spans = carried(pairs, F.lit(0).cast("bigint"), add, kind)
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPAN))


def parts(text: Column) -> Column:
    """A text in parts of ``PART`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))


def cut(of: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (from 0) of a text given in ``parts``."""
    first = (start / PART).cast("int")
    last = ((start + size) / PART).cast("int")
    near = F.array_join(between(of, first, last), "")
    return F.substring(near, (start - first * PART + 1).cast("int"), size.cast("int"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
