"""Secrets: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, one on ordinary identifiers; a long token whose characters
follow each other as in random strings is reported as ``random``. Training counts pairs of character
classes in SQL; the two tables of ``CLASSES`` x ``CLASSES`` counts are all that reaches the driver.
Scanning is SQL functions over one scan, nothing is shuffled.

Nulls count as empty texts, empty tables give no rows (the models are then flat and report nothing),
repeated rows and other columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.llm import spans as sp

#: The patterns of the base kinds. ``hex`` takes maximal runs of 16 and more.
ASSIGN = (
    r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?((?-i)[A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f](?<![0-9a-f][0-9a-f])[0-9a-f]{15,}+"
BASE = ("assign", "access", "hex")
_TOKEN = "A-Za-z0-9+/_=-"
#: What the models look at: maximal runs of 20 characters and more that hold a digit.
TOKEN = rf"[{_TOKEN}](?<![{_TOKEN}][{_TOKEN}])[{_TOKEN}]{{19,}}+"

CLASSES = 64  # letters of both cases, digits, and one class for the rest
SAMPLE_DOCS = 2_000  # documents whose words serve as ordinary identifiers, at most about this many
THRESHOLD = 0.5  # log-likelihood ratio for each transition
NEUTRAL = 40.0  # weight of the flat prior, in pairs for each class


def _class(char: Column) -> Column:
    """0..25 a-z, 26..51 A-Z, 52..61 digits, 62 everything else."""
    code = F.ascii(char)
    return (
        F.when(code.between(97, 122), code - 97)
        .when(code.between(65, 90), code - 39)
        .when(code.between(48, 57), code + 4)
        .otherwise(62)
    )


def _pairs(token: Column) -> Column:
    """Class pairs of neighbouring characters, as first * CLASSES + second."""
    codes = F.transform(F.split(token, "", F.length(token)), _class)
    return F.zip_with(
        F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))),
        F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: a * CLASSES + b,
    )


def labelled_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """Training sample (token, random): words of sampled documents, and digests of their keys.

    Documents are drawn by a hash of the key; ``sample_docs`` bounds how many are expected. The
    digests come as hexadecimal, base 64 and upper-case letters with digits.
    """
    total = max(df.count(), 1)
    drawn = F.pmod(F.xxhash64(F.lit("identifiers"), F.col(key)), F.lit(1_000_000))
    share = min(1.0, sample_docs / total)
    picked = df.where(drawn < int(share * 1_000_000)).select(key, text)
    words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z_]{3,}"), F.lit(0)))
    ordinary = picked.select(F.explode(words).alias("token")).distinct()
    digest = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.col(key)), 256)
    shuffled = F.translate(
        F.upper(digest("u")), "0123456789ABCDEF", "QZ7XKW2MJ9VH4TPC"
    )
    random = picked.select(
        F.explode(
            F.array(digest("h"), F.base64(F.unhex(digest("b"))), F.base64(F.unhex(digest("c"))), shuffled)
        ).alias("token")
    )
    return ordinary.withColumn("random", F.lit(False)).unionByName(
        random.withColumn("random", F.lit(True))
    )


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each class pair, random over ordinary, from (token, random)."""
    counted = (
        samples.select("random", F.explode(_pairs(F.col("token"))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()  # two tables of CLASSES x CLASSES at most
    )
    counts = {True: [0.0] * CLASSES**2, False: [0.0] * CLASSES**2}
    for row in counted:
        counts[row["random"]][row["pair"]] = float(row["count"])
    logs = {}
    for label, table in counts.items():
        logs[label] = []
        for first in range(CLASSES):
            line = table[first * CLASSES : (first + 1) * CLASSES]
            whole = sum(line) + NEUTRAL
            logs[label] += [math.log((n + NEUTRAL / CLASSES) / whole) for n in line]
    return [round(a - b, 6) for a, b in zip(logs[True], logs[False], strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over the transitions of ``token``; 0 without any."""
    table = F.from_json(F.lit("[" + ",".join(map(str, model)) + "]"), "array<double>")
    pairs = _pairs(token)
    total = F.aggregate(
        pairs, F.lit(0.0), lambda a, pair: a + F.coalesce(F.get(table, pair), F.lit(0.0))
    )
    return total / F.greatest(F.size(pairs), F.lit(1))


def _span(rank: int, kind: str, s: Column, score: Column) -> Column:
    return F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
        F.lit(kind).alias("kind"), score.alias("score"),
    )


def _apart(spans: Column, threshold: float) -> Column:
    """Sorted spans without the ``random`` ones below ``threshold`` or over a base span.

    A random span is over one if a base span before it ends behind its start, or one after it starts
    before its end.
    """
    is_base = lambda s: s["rank"] < len(BASE)
    far = F.lit((1 << 62)).cast("bigint")
    ended = lambda end, s: (F.when(is_base(s), F.greatest(end, s["end"])).otherwise(end), end)
    begins = lambda at, s: (F.when(is_base(s), s["start"]).otherwise(at), at)

    def kept(own: Column) -> Column:
        before = sp.carried(own, F.lit(0).cast("bigint"), ended, "bigint")
        after = F.reverse(sp.carried(F.reverse(own), far, begins, "bigint"))
        placed = F.arrays_zip(own.alias("span"), before.alias("before"), after.alias("after"))
        free = F.filter(
            placed,
            lambda p: is_base(p["span"])
            | (
                (p["span"]["score"] >= threshold)
                & (p["before"] <= p["span"]["start"]) & (p["after"] >= p["span"]["end"])
            ),
        )
        return F.transform(free, lambda p: p["span"])

    return sp.let(spans, kept)


def find_secrets(
    df: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Append ``secrets``: array of (start, rank, end, kind, score), by start and then kind.

    Every base match is there with score 1; ``random`` tokens are those of ``TOKEN`` whose ratio
    reaches ``threshold`` and that overlap no base match.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    hits = df.withColumns(
        {
            "_assign": sp.found(whole, ASSIGN),
            "_access": F.when(F.contains(whole, F.lit("AKIA")), sp.found(whole, ACCESS)).otherwise(
                F.array().cast("array<string>")
            ),
            "_hex": sp.found(whole, HEX),
            "_token": sp.found(whole, TOKEN),
        }
    )
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1))
    one = F.lit(1.0)
    assign = F.filter(sp.located(whole, F.col("_assign"), ASSIGN), lambda s: value(s) >= 12)
    access = F.filter(
        sp.located(whole, F.col("_access"), ACCESS), lambda s: F.length(s["hit"]) >= 18
    )
    base = F.concat(
        F.transform(assign, lambda s: _span(0, "assign", s, one)),
        F.transform(access, lambda s: _span(1, "access", s, one)),
        F.transform(sp.located(whole, F.col("_hex"), HEX), lambda s: _span(2, "hex", s, one)),
    )
    # positions are needed only where some token can count
    mixed = F.exists("_token", lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
    tokens = F.when(mixed, sp.located(whole, F.col("_token"), TOKEN)).otherwise(
        F.array().cast(sp.SPAN)
    )
    tokens = F.filter(tokens, lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]"))
    scored = F.transform(tokens, lambda s: _span(3, "random", s, ratio(s["hit"], model)))
    based = hits.withColumns({"_base": base, "_scored": scored})
    return based.withColumn("secrets", _apart(F.array_sort(F.concat("_base", "_scored")), threshold)).drop(
        "_assign", "_access", "_hex", "_token", "_base", "_scored"
    )


def report(
    df: DataFrame, model: list[float], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: counts and digest of the base spans, and all spans as a string."""
    marked = find_secrets(df.select(key, text), model, text).select(key, "secrets")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    count = lambda rank: F.size(F.filter("secrets", lambda s: s["rank"] == rank))
    return marked.select(
        key,
        *[count(rank).cast("bigint").alias(f"n_{name}") for rank, name in enumerate(BASE)],
        F.sha2(sp.joined(base), 256).alias("base_sha256"),
        sp.joined(F.col("secrets")).alias("spans"),
    )
