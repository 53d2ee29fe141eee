"""Language ID by compression: the language whose dictionary makes a text smallest.

Per language, windows at hashed places of sampled labelled documents form a raw-content zstandard dictionary. A text is
folded to lower case without digits and punctuation, cut into blocks (so that a text's own repeats
cannot replace the dictionary), and every block of the whole text is compressed with every dictionary.
The smallest total wins; a narrow margin rejects. Equal totals go to the language with more documents.

A null text, and one without a letter, is ``und`` with score 0 and rejected; so is every text if no
language was learned. Empty tables give no rows, repeated rows equal results; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.session import ship_package

SAMPLE_DOCS = 80  # documents sampled for a language, about
WINDOW = 800  # characters of each that go into the dictionary, from anywhere in its text
BLOCK = 1_000  # bytes compressed at a time
LEVEL = 6
MARGIN = 0.001  # of the second smallest total; below, the text is rejected
UNDECIDED = "und"

_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "ignore").translate(_FOLD).split())


def dictionaries(
    df: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS
) -> list[tuple[str, bytes]]:
    """(language, dictionary), most frequent language first; ``df`` holds the labelled rows.

    Rows are drawn by a hash of the text at a rate set by the language's row count; about
    ``sample_docs`` different texts a language, and of each a window of ``WINDOW`` characters at a place
    that the text's hash gives, come to the driver: 64 kB a language for texts in one-byte letters. All of
    them count.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rate = F.create_map(
        *[
            F.lit(x)
            for name, n in counts.items()
            for x in (name, int(min(1.0, sample_docs / n) * (1 << 40)))
        ]
    )
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    begin = (F.pmod(F.xxhash64(F.lit("window"), "text"), room) + 1).cast("int")
    drawn = (
        known.where(place < F.element_at(rate, F.col("lang")))
        .select("lang", place.alias("place"), F.substring("text", begin, F.lit(WINDOW)).alias("text"))
        .dropDuplicates(["lang", "place"])  # copies of a drawn text come once
        .collect()
    )
    parts: dict[str, dict[int, bytes]] = {}
    for row in drawn:
        parts.setdefault(row["lang"], {})[row["place"]] = folded(row["text"])
    order = sorted(parts, key=lambda name: (-counts[name], name))
    joined = {n: b" ".join(p for _, p in sorted(parts[n].items())) for n in order}
    return [(name, joined[name]) for name in order if joined[name]]


def _compressors(model: list[tuple[str, bytes]]):
    import zstandard

    made = []
    for _, content in model:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        own.precompute_compress(compression_params=parameters)
        made.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=own))
    return made


def judge(text: str | None, names: list[str], compressors: list) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text."""
    if not isinstance(text, str) or not names or not any(map(str.isalpha, text)):
        return UNDECIDED, 0.0, True
    plain = folded(text)
    blocks = [plain[at : at + BLOCK] for at in range(0, len(plain), BLOCK)]
    sizes = [sum(len(c.compress(block)) for block in blocks) for c in compressors]
    best = min(sizes)
    # every byte saved doubles the odds
    score = 1.0 / sum(2.0 ** -min(size - best, 1_000) for size in sizes)
    rest = sorted(sizes)[1:2]
    narrow = bool(rest) and rest[0] - best < max(MARGIN * rest[0], 1)
    return names[sizes.index(best)], score, narrow


def verdict(df: DataFrame, model: list[tuple[str, bytes]], text: str = "text") -> Column:
    """Column of struct (lang, score, rejected) for the texts of ``df``."""
    ship_package(df.sparkSession)
    names = [name for name, _ in model]

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(model)
        for texts in batches:
            rows = [judge(t, names, compressors) for t in texts]
            yield pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return predict(F.col(text))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training; a null key is none of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def report(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Prediction for every row, learned from the labelled rows that are not held out."""
    model = dictionaries(df.where(~held_out(key)), text, lang)
    found = df.select(key, held_out(key).alias("held_out"), verdict(df, model, text).alias("_v"))
    return found.select(
        key, "held_out", F.col("_v.lang").alias("lang_pred"), F.col("_v.score").alias("score"),
        F.col("_v.rejected").alias("rejected"),
    )


def recognised(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` whose language is not rejected, with their columns as they are."""
    model = dictionaries(df.where(~held_out(key)), text, lang)
    return df.where(~verdict(df, model, text)["rejected"])
