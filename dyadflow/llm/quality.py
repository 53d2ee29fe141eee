"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

Every whole text is reduced to ``STATISTICS`` once and the result written. On the labelled rows, random
Fourier features of the standardised statistics approximate a Gaussian kernel; partitions sum their own
normal equations, of which only ``FEATURES`` squared numbers reach the driver whatever the rows. Raw
scores are counted in ``BINS`` bins, over all labelled rows, and made monotone by pooling neighbours.

Null texts count as empty; every text gets a score. Without labels, or with one label only, every score
is the share of label 1 (0.5 without any). Repeated rows are scored alike; repeated labels of a key
count once, by their mean. Other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.session import ship_package
from dyadflow.staging import stage

FEATURES = 256
RIDGE = 1e-3  # for each row
GAMMA = 0.5  # of the kernel, divided by the number of statistics
BINS = 4_096
ROWS_PER_SUM = 50_000  # labelled rows whose normal equations one task adds up
SEED = 2
CUT = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "letters", "digits", "capitals", "spaces", "symbols",
    "marks", "line_log", "lines_repeated", "lines_open", "words_distinct", "words_symbol",
    "words_short", "words_long", "words_top", "words_capital", "pairs_repeated", "longest_word",
)
_SYMBOLS = b"#$%&*@^~|<>{}[]\\/=_+"
_MARKS = b".,;:!?\"'()-"
_WITH_SYMBOL = re.compile(rb"[#$%&*@^~|<>{}\[\]\\/=_+!]{2,}")


def statistics(text: bytes | None) -> list[float]:
    """``STATISTICS`` of a text in UTF-8; all zero for an empty one."""
    raw = text or b""
    words = raw.split()
    if not words:
        return [math.log1p(len(raw))] + [0.0] * (len(STATISTICS) - 1)
    size, many = len(raw), len(words)
    without = lambda chars: size - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = list(map(len, words))
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    capitals = without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = without(b"abcdefghijklmnopqrstuvwxyz") + capitals + sum(raw.count(c) for c in (b"\xc3",))
    return [
        math.log1p(size), math.log1p(many), sum(lengths) / many, letters / size,
        without(b"0123456789") / size, capitals / size, without(b" \t\n\r\x0b\x0c") / size,
        without(_SYMBOLS) / size, without(_MARKS) / size, math.log1p(size / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(not x.rstrip().endswith((b".", b"!", b"?", b'"', b":")) for x in lines) / len(lines),
        len(counts) / many, len(_WITH_SYMBOL.findall(raw)) / many,
        sum(n <= 2 for n in lengths) / many, sum(n >= 14 for n in lengths) / many,
        counts.most_common(1)[0][1] / many, sum(w[:1].isupper() for w in words) / many,
        1 - len(pairs) / max(many - 1, 1), math.log1p(max(lengths)),
    ]


def with_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stats) for every row."""
    ship_package(df.sparkSession)
    source = df.select(F.col(key).alias("key"), F.encode(text, "UTF-8").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["key", "stats"])

    return source.mapInArrow(run, f"key {kind}, stats array<double>")


class Model:
    """Standardisation, random directions, ridge weights and calibration steps: a few hundred KB."""

    def __init__(self, mean, spread):
        draw = np.random.default_rng(SEED)
        width = len(STATISTICS)
        self.mean, self.spread = np.asarray(mean), np.where(np.asarray(spread) > 1e-9, spread, 1.0)
        self.directions = draw.normal(0, math.sqrt(2 * GAMMA / width), (width, FEATURES))
        self.phases = draw.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, stats) -> np.ndarray:
        """Rows of statistics → random Fourier features and a constant."""
        plain = np.clip((np.asarray(stats, dtype=float) - self.mean) / self.spread, -8, 8)
        waves = math.sqrt(2 / FEATURES) * np.cos(plain @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(plain), 1))])

    def raw(self, stats) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, 0, 1)

    def score(self, stats) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels)


def _stats(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _normal_equations(train: DataFrame, model: Model, rows: int) -> np.ndarray:
    """Sum over (stats, label) rows of features x (features, label)."""

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                z = model.features(_stats(part.column(0)))
                y = part.column(1).to_numpy(zero_copy_only=False)
                total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
            names=["line", "sums"],
        )

    def add(table):
        import pyarrow as pa

        sums = np.vstack(table.column("sums").to_pylist()).sum(axis=0)
        return pa.table({"line": table.column("line")[:1], "sums": pa.array([sums], pa.list_(pa.float64()))})

    kind = "line int, sums array<double>"
    parts = train.repartition(max(1, math.ceil(rows / ROWS_PER_SUM))).mapInArrow(partial, kind)
    lines = parts.groupBy("line").applyInArrow(add, kind).collect()  # FEATURES + 1 rows
    out = np.zeros((FEATURES + 1, FEATURES + 2))
    for row in lines:
        out[row["line"]] = row["sums"]
    return out


def pooled(counts: list[tuple[int, float, float]]) -> list[tuple[int, float]]:
    """Isotonic fit of (bin, rows, sum of labels) in order: (bin, level), levels never falling."""
    blocks: list[list] = []
    for number, rows, total in counts:
        blocks.append([[number], rows, total])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return [(n, total / rows) for numbers, rows, total in blocks for n in numbers]


def fit(train: DataFrame) -> Model:
    """Model from (stats, label) rows, label 0.0 or 1.0."""
    width = range(len(STATISTICS))
    moments = train.agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("share"),
        *[F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in width],
        *[F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in width],
    ).first()
    rows = moments["n"]
    model = Model([moments[f"m{i}"] or 0.0 for i in width], [moments[f"s{i}"] or 0.0 for i in width])
    share = 0.5 if not rows else moments["share"]
    model.weights[-1], model.levels = share, np.array([share])
    if not rows or share in (0.0, 1.0):
        return model
    sums = _normal_equations(train, model, rows)
    penalty = np.diag([RIDGE * rows] * FEATURES + [0.0])
    model.weights = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

    def bins(batches):
        import pyarrow as pa

        for batch in batches:
            place = np.minimum(model.raw(_stats(batch.column(0))) * BINS, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["bin", "label"])

    counted = train.mapInArrow(bins, "bin int, label double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("total")
    )
    steps = pooled(sorted((r["bin"], r["n"], r["total"]) for r in counted.collect()))
    model.edges = (np.array([n for n, _ in steps]) + 0.5) / BINS
    model.levels = np.array([level for _, level in steps])
    return model


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training; a null key is none of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """(key, stats) → (key, score)."""
    kind = stats.schema["key"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = model.score(_stats(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["key", "score"])

    return stats.select("key", "stats").mapInArrow(run, f"key {kind}, score double")


def report(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """Score of every row, learned from the labelled rows that are not held out."""
    stats = stage(with_statistics(df, key, text), "statistics")
    known = labels.groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("label")).dropna()
    train = stage(stats.where(~held_out("key")).join(known, "key").select("stats", "label"), "labelled")
    return scores(stats, fit(train)).select(
        F.col("key").alias(key), held_out("key").alias("held_out"), "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
