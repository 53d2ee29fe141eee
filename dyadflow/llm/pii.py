"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score.

Everything is SQL functions over one scan; nothing is shuffled. Nulls count as empty texts; tables
without rows give none; repeated rows and other columns pass through untouched.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are kept whenever their own test passes. Further
kinds are kept when their score reaches ``threshold``:

* ``iban``: letters and digits of an account number, confirmed by the remainder modulo 97;
* ``ssn``: 3-2-4 digits, which carry no checksum, so that words nearby decide;
* ``local_phone``: 3-3-4 digits without a country code, likewise.

Patterns take maximal runs: what precedes a run is looked at only behind a first character that fits,
and runs are possessive, so that the time is linear in the text. An account number may be followed by
capitals or digits: every start is looked at over 68 characters, and its end is where the country's
length and the remainder say.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.llm import spans as sp
from dyadflow.llm.rows import boxed

CONTEXT_CHARS = 48
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a string without which no match exists; empty: none
    prior: float
    context: str  # words nearby that support the kind
    base: bool = False


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind(
        "email",
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, r"mail|kontakt|contact|write|schreib|correo|courriel", True,
    ),
    Kind(
        "ip",
        r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
        ".", 0.6, r"ip|host|server|address|adresse|login", True,
    ),
    Kind(
        "card",
        r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
        "", 0.8, r"card|visa|credit|karte|tarjeta|carte", True,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "+", 0.7, r"tel|phone|call|fax|mobil|ruf", True,
    ),
    Kind(
        "iban",
        r"[A-Z](?<![A-Za-z0-9][A-Z])(?=[A-Z][0-9]{2}(?: ?[A-Z0-9]){11})",  # starts; _accounts() finds the end
        "", 0.3, r"iban|account|konto|bank|cuenta|compte",
    ),
    Kind(
        "ssn",
        r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-", 0.2, r"ssn|social|security|versicherung|seguridad",
    ),
    Kind(
        "local_phone",
        r"\(?[0-9](?<![0-9+][0-9])[0-9]{2}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
        "", 0.2, r"tel|phone|call|fax|mobil|ruf|llam",
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)
_ACCOUNT = r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+"
_ACCOUNT_CHARS = 68  # 34 letters and digits with a space before each
#: Letters and digits of an account number by country.
ACCOUNT_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the doubled-and-summed digits are divisible by ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(
        values,
        lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters last and letters as 10..35, leaves 1."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        letter = (rest * 100 + code - 55) % 97
        return F.when(char == "", rest).otherwise(
            F.when(code >= 65, letter).otherwise((rest * 10 + code - 48) % 97)
        )

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _account_end(run: Column) -> Column:
    """How many characters of a run, from its start, are an account number; null if none are.

    The country's length if its remainder is right, else the whole run; for countries without a known
    length the longest that ends with a group or the run.
    """
    at = lambda i: F.substring(run, i, F.lit(1))
    ends = F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: at(i) != " ")
    lengths = F.create_map(*[F.lit(x) for pair in ACCOUNT_LENGTHS.items() for x in pair])
    known = lengths[F.substring(run, 1, 2)]
    groups = F.filter(
        F.slice(ends, 15, 34), lambda i: (i == F.length(run)) | (at(i + 1) == " ")
    )
    tried = F.when(known.isNull(), F.reverse(groups)).otherwise(F.array(F.get(ends, known - 1), F.length(run)))
    return F.get(F.filter(tried, lambda i: i.isNotNull() & mod97(F.substring(run, F.lit(1), i))), 0)


def _accounts(chars: Column, starts: Column) -> Column:
    """Account numbers at the given starts; one that begins within another before it is dropped."""
    runs = F.transform(
        starts,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.regexp_extract(
                sp.cut(chars, s["start"], F.lit(_ACCOUNT_CHARS)), _ACCOUNT, 0
            ).alias("run"),
        ),
    )
    ended = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["run"].alias("run"), _account_end(r["run"]).alias("size")))
    found = F.transform(
        F.filter(ended, lambda r: r["size"].isNotNull()),
        lambda r: F.struct(
            r["start"].alias("start"), (r["start"] + r["size"]).alias("end"),
            F.substring(r["run"], F.lit(1), r["size"]).alias("hit"),
        ),
    )

    def apart(end: Column, r: Column) -> tuple[Column, Column]:
        stays = r["start"] >= end
        return F.when(stays, r["end"]).otherwise(end), F.when(stays, r)

    kind = sp.SPAN.removeprefix("array<").removesuffix(">")
    kept = sp.carried(found, F.lit(0).cast("bigint"), apart, kind)
    return F.filter(kept, lambda r: r.isNotNull())


def _confirmed(kind: str, hit: Column) -> Column:
    """The test a match must pass; a match that fails is dropped."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _score(kind: Kind, chars: Column, span: Column) -> Column:
    """Prior, raised by a checksum that holds and by a supporting word within ``CONTEXT_CHARS``."""
    begin = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    near = F.lower(sp.cut(chars, begin, span["end"] - begin + CONTEXT_CHARS))
    checked = 0.4 if kind.name in ("card", "iban") else 0.0
    score = F.lit(kind.prior + checked) + F.when(near.rlike(kind.context), 0.35).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def _spans(rank: int, kind: Kind, whole: Column, threshold: float) -> Column:
    placed = sp.located(whole, F.col(f"_hits_{kind.name}"), kind.pattern)
    if kind.name == "iban":
        placed = _accounts(F.col("_chars"), placed)
    placed = F.filter(placed, lambda s: _confirmed(kind.name, s["hit"]))
    scored = F.transform(
        placed,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
            F.lit(kind.name).alias("kind"), _score(kind, F.col("_chars"), s).alias("score"),
        ),
    )
    return scored if kind.base else F.filter(scored, lambda s: s["score"] >= threshold)


def find_pii(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append ``pii``: array of (start, rank, end, kind, score), by start and then kind.

    ``rank`` is the place of the kind in ``KINDS``. Base kinds do not depend on ``threshold``.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    hits = df.withColumns(
        {
            f"_hits_{k.name}": F.when(F.contains(whole, F.lit(k.gate)), sp.found(whole, k.pattern)).otherwise(none)
            if k.gate
            else sp.found(whole, k.pattern)
            for k in KINDS
        }
    )
    some = functools.reduce(operator.or_, [F.size(f"_hits_{k.name}") > 0 for k in KINDS])
    hits = hits.withColumn("_chars", F.when(some, sp.parts(whole)).otherwise(none))
    spans = [_spans(rank, kind, whole, threshold) for rank, kind in enumerate(KINDS)]
    return hits.withColumn("pii", F.array_sort(F.concat(*spans))).drop(
        "_chars", *[f"_hits_{k.name}" for k in KINDS]
    )


def redact(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Replace every span by ``<KIND>``; spans that overlap become one, named by the first.

    Texts without a span, nulls included, stay as they are; so do all other columns, whatever their names.
    """
    marked = find_pii(df.select(boxed(df).alias("_row"), F.col(text).alias("_text")), "_text", threshold)
    source = F.col("_text")

    def open_at(end: Column, span: Column) -> tuple[Column, Column]:
        """What is left open before a span; null for a span that begins within those before it."""
        fresh = F.struct(end.alias("at"), span["start"].alias("start"), span["kind"].alias("kind"))
        return F.greatest(end, span["end"]), F.when(span["start"] >= end, fresh)

    def rebuild(chars: Column) -> Column:
        gaps = sp.carried(F.col("pii"), F.lit(0).cast("bigint"), open_at, "struct<at:bigint,start:bigint,kind:string>")
        told = F.transform(
            F.filter(gaps, lambda g: g.isNotNull()),
            lambda g: F.concat(sp.cut(chars, g["at"], g["start"] - g["at"]), F.lit("<"), F.upper(g["kind"]), F.lit(">")),
        )
        end = F.array_max(F.transform(F.col("pii"), lambda s: s["end"]))
        return F.concat(F.array_join(told, ""), F.substring(source, (end + 1).cast("int"), F.length(source)))

    rebuilt = sp.let(sp.parts(source), rebuild)
    clean = F.when(F.size("pii") > 0, rebuilt).otherwise(source)
    return marked.select(F.col("_row").withField(f"`{text}`", clean).alias("_row")).select("_row.*")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts and digest of the base spans, and all spans as a string."""
    marked = find_pii(df.select(key, text), text).select(key, "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    count = lambda rank: F.size(F.filter("pii", lambda s: s["rank"] == rank)).cast("bigint")
    return marked.select(
        key,
        *[count(rank).alias(f"n_{name}") for rank, name in enumerate(BASE)],
        F.sha2(sp.joined(base), 256).alias("base_sha256"),
        sp.joined(F.col("pii")).alias("spans"),
    )
