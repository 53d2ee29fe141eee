"""How the sources of a language differ in their words: counts of every term, exact divergences.

Terms are found in the bytes of a batch of texts at once. Terms of up to 8 bytes are one big-endian
64-bit word, of up to 16 bytes two; no term holds a zero byte, so padding by zeros is unambiguous and
words sort as their bytes do. Each length bucket is radix-sorted, 16 bits a pass, behind the group and
the document, and its runs are counted: occurrences and documents of each term in each group. Longer
terms form a bucket of their own, sorted as bytes. What a batch yields is added up by Spark before and
after the shuffle, so a frequent term or a large group costs one row per task.

The divergence of two sources sums over all kept terms of their language. Terms that one side lacks
have a probability that depends on the group alone, so the sum falls into parts: all terms absent, a
correction for each term of one side, which depends on its count only and is taken from the counts of
counts, and one for terms of both sides. Only the last needs terms met by term; it is added up in numpy
over blocks of terms and leaves a task as one row per pair of sources.

Null text, lang and source are ''. A table without rows gives none; a group without terms has its pairs
with value 0 if its language keeps no term. Repeated rows are documents of their own. Other columns play
no part. A batch holds one whole text at least, and about 20 times its bytes of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.session import ship_package
from dyadflow.staging import stage

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
BATCH_BYTES = 1 << 22
PAIRS_HELD = 1 << 20  # pair sums a task holds before it hands them on
BLOCK_ROWS = 1 << 16  # counts of a language that are laid out as one matrix


def _radix(columns) -> object:
    """The order of rows by ``columns`` (last one first), stable, 16 bits a pass; passes over equal bits are skipped."""
    import numpy as np

    order = None
    for column in columns:
        for shift in range(0, 8 * column.itemsize, 16):
            digit = ((column >> column.dtype.type(shift)) & column.dtype.type(0xFFFF)).astype(np.uint16)
            if not len(digit) or (digit == digit[0]).all():
                continue
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def _runs(starts_new):
    """Where runs begin, given whether each row but the first differs from the one before."""
    import numpy as np

    return np.flatnonzero(np.concatenate([[True], starts_new]))


def _counted(words, group, document) -> tuple:
    """Rows of (term words, group, document) → first rows of each (group, term), occurrences and documents.

    Documents are numbered along the groups, so the document's number orders both.
    """
    import numpy as np

    order = _radix([document, *words[::-1], group])
    words = [w[order] for w in words]
    group, document = group[order], document[order]
    new_term = group[1:] != group[:-1]
    for w in words:
        new_term |= w[1:] != w[:-1]
    first = _runs(new_term)
    new_document = np.concatenate([[True], new_term | (document[1:] != document[:-1])])
    n = np.diff(np.append(first, len(group)))
    documents = np.add.reduceat(new_document.astype(np.int64), first)
    return order[first], n, documents


def term_runs(texts: list[bytes], groups: list[int]) -> Iterator[tuple[bytes, int, int, int]]:
    """(term, group, occurrences, documents) of a batch of texts, each with its group's number."""
    import numpy as np

    whole = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    upper = (whole >= 65) & (whole <= 90)
    folded = np.where(upper, whole | 32, whole)
    inside = ((folded >= 97) & (folded <= 122)) | (folded >= 128)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return
    ends = np.cumsum([len(t) + 1 for t in texts])
    document = np.searchsorted(ends, start, side="right").astype(np.uint32)
    group = np.array(groups, dtype=np.uint32)[document]
    padded = np.concatenate([folded, np.zeros(16, dtype=np.uint8)])
    for low, high in ((0, 8), (8, 16)):
        own = np.flatnonzero((size > low) & (size <= high))
        if not len(own):
            continue
        letters = padded[start[own, None] + np.arange(high)]
        letters[np.arange(high) >= size[own, None]] = 0
        words = letters.view(">u8").astype(np.uint64)
        at, n, documents = _counted([words[:, i] for i in range(high // 8)], group[own], document[own])
        terms = [t.tobytes().rstrip(b"\0") for t in letters[at]]
        yield from zip(terms, group[own][at].tolist(), n.tolist(), documents.tolist(), strict=True)
    own = np.flatnonzero(size > 16)
    if len(own):
        data = folded.tobytes()
        rows = sorted(
            (g, data[a : a + s], d)
            for g, a, s, d in zip(group[own].tolist(), start[own].tolist(), size[own].tolist(), document[own].tolist(), strict=True)
        )
        last, n, documents, seen = None, 0, 0, None
        for g, term, d in rows:
            if (g, term) != last:
                if last is not None:
                    yield last[1], last[0], n, documents
                last, n, documents, seen = (g, term), 0, 0, None
            n, documents, seen = n + 1, documents + (d != seen), d
        yield last[1], last[0], n, documents


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, documents): occurrences of each term and documents that hold it, by group."""
    ship_package(df.sparkSession)
    plain = df.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        def rows(pairs, texts):
            names = list(dict.fromkeys(pairs))
            number = {p: i for i, p in enumerate(names)}
            found = list(term_runs(texts, [number[p] for p in pairs]))
            terms, group, n, documents = zip(*found, strict=True) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([names[g][0] for g in group], pa.string()), pa.array([names[g][1] for g in group], pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(n, pa.int64()), pa.array(documents, pa.int64()),
                ],
                names=["lang", "source", "term", "n", "documents"],
            )

        pairs, texts, held = [], [], 0
        for batch in batches:
            for a, b, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pairs.append((a, b))
                texts.append(t)
                held += len(t)
                if held >= BATCH_BYTES:
                    yield rows(pairs, texts)
                    pairs, texts, held = [], [], 0
        if texts:
            yield rows(pairs, texts)

    partial = plain.mapInArrow(run, "lang string, source string, term string, n bigint, documents bigint")
    return partial.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents")
    )


def _probability(count: str, whole: str) -> Column:
    """1 + floor(SCALE * (count + 2) / whole) by long division, exact while ``whole`` is below 9e15."""
    parts, rest = [], f"({count} + 2)"
    for _ in range(3):  # three digits at a time
        parts.append(f"(({rest}) * 1000 div ({whole}))")
        rest = f"(({rest}) * 1000 % ({whole}))"
    return F.expr(f"1 + ({parts[0]} * 1000 + {parts[1]}) * 1000 + {parts[2]}")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _met(kept: DataFrame) -> DataFrame:
    """(lang, term, source, p, none) → (lang, source, item, value): over terms that both sources have, what the
    divergence differs by from taking either side's count as none. ``none`` is a source's p of an absent term."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[tuple[str, str, str], int] = {}

        def apart(p, q):
            return (p - q) * (p - q) // (p + q)

        def add(lang, terms, sources, p, none):
            """Counts of whole terms of one language: a matrix of terms by the sources met."""
            names, place = np.unique(np.array(sources, dtype=object), return_inverse=True)
            number = np.cumsum(np.concatenate([[0], np.array(terms[1:], dtype=object) != np.array(terms[:-1], dtype=object)])).astype(np.int64)
            absent = np.zeros(len(names), dtype=np.int64)
            absent[place] = none
            for low in range(0, int(number[-1]) + 1, step := max(1, (1 << 20) // len(names))):
                rows = (number >= low) & (number < low + step)
                table = np.repeat(absent[None, :], int(number[rows].max()) - low + 1, axis=0)
                table[number[rows] - low, place[rows]] = np.array(p)[rows]
                for i, name in enumerate(names):
                    have = table[:, i] != absent[i]
                    own, none_i = table[have, i, None], absent[i]
                    part = table[have]
                    gain = apart(own, part) - apart(own, absent) - apart(none_i, part) + apart(none_i, absent)
                    for j, value in enumerate(gain.sum(axis=0).tolist()):
                        if value and j != i:
                            key = (lang, name, names[j])
                            sums[key] = sums.get(key, 0) + value

        def out():
            rows = [(*k, v) for k, v in sums.items()]
            sums.clear()
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "item", "value"]
            )

        held, lang = ([], [], [], []), None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                new_term = not held[0] or row[1] != held[0][-1]
                if held[0] and (row[0] != lang or (new_term and len(held[0]) >= BLOCK_ROWS)):
                    add(lang, *held)
                    held = ([], [], [], [])
                    if len(sums) > PAIRS_HELD:
                        yield out()
                lang = row[0]
                for column, value in zip(held, row[1:], strict=True):
                    column.append(value)
        if held[0]:
            add(lang, *held)
        if sums:
            yield out()

    ordered = kept.select("lang", "term", "source", "p", "none").repartition("lang", "term").sortWithinPartitions("lang", "term")
    met = ordered.mapInArrow(run, "lang string, source string, item string, value bigint")
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("met"))


def report(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and
    the terms that set it apart from the language as a whole."""
    counts = stage(term_counts(df, text, lang, source), "terms")
    whole = (
        counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents"))
        .where(F.col("documents") >= least_documents).drop("documents")
    )
    rows = stage(counts.drop("documents").join(whole, ["lang", "term"]), "kept_terms")
    occurring = df.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))
    ).distinct()
    # V of each language, N of each language and group
    size = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    zero = F.lit(0).cast("bigint")
    groups = stage(
        occurring.join(size, "lang", "left").join(own, ["lang", "source"], "left").select(
            "lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("n_lang", zero).alias("n_lang"),
            F.coalesce("n_group", zero).alias("n_group"),
        )
        .withColumn("m", F.expr("n_group + 2 * v")).withColumn("m_lang", F.expr("n_lang + 2 * v"))
        .withColumn("none", F.when(F.col("v") > 0, _probability("0", "m"))),
        "groups",
    )
    kept = stage(
        rows.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", "none", _probability("n", "m").alias("p"),
            _probability("total", "m_lang").alias("q"),
        ),
        "probabilities",
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = (
        kept.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )
    # what the terms of one side change, from the counts of its counts
    counted = kept.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("times"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none_item"))
    one_side = stage(
        counted.join(other, "lang").where("source <> item")
        .withColumn("change", _apart("p", "none_item") - _apart("none", "none_item"))
        .groupBy("lang", "source", "item").agg(F.sum(F.col("times") * F.col("change")).alias("change")),
        "one_side",
    )
    other_side = one_side.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("change").alias("back")
    )
    keys = ["lang", "source", "item"]
    pairs = (
        groups.select("lang", "source", "v", "none").join(other, "lang").where("source <> item")
        .join(one_side, keys, "left").join(other_side, keys, "left").join(_met(kept), keys, "left")
        .select(*keys, F.coalesce(F.col("v") * _apart("none", "none_item"), zero).alias("base"), "change", "back", "met")
        .withColumn("value", F.expr("base + coalesce(change, 0) + coalesce(back, 0) + coalesce(met, 0)"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    )
    return pairs.unionByName(terms)
