"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size of the source. Within the
source, rows are sorted by size (so that neighbours have like sizes and what is taken stays within
about one document of the target), the expected copies are added up, one offset for the source is
added, and a document is emitted once for every integer its own stretch crosses. Expected copies are
integers in units of 2**-24, so sums are exact and reruns agree whatever the partitioning.

A null text has size 0; the null source is a source of its own, last in order; empty tables give no
rows; repeated rows are rows of their own; other columns play no part. A source without words gets
target 0. The rows stay in JVM columns throughout; the driver sees a few sums for each step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.ranges import prefix_sum, range_sorted
from dyadflow.llm.rows import boxed, named
from dyadflow.staging import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2
UNIT_BITS = 24
SEED = 20


def word_count(text: Column) -> Column:
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING
) -> DataFrame:
    """(source, source_size) → (rank, source, weight, source_size, target).

    Weights repeat over the sources in order of code points, null last. The targets add up to
    ``share`` of all sizes; what a source would get beyond ``ceiling`` times its size goes to the
    others by weight, until none is above.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = prefix_sum(range_sorted(sizes, order, "sources"), [], order, F.lit(1), "rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.select(
        F.col("rank").cast("bigint").alias("rank"), "source", "source_size",
        F.get(cycle, (F.col("rank") % len(weights)).cast("int")).cast("bigint").alias("weight"),
    )
    table = stage(weighed, "weights")
    first = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, free = share * (first["size"] or 0), first["weight"] or 1
    cap = F.col("source_size") * ceiling
    while True:
        above = F.lit(left) * F.col("weight") / F.lit(free) > cap
        now = table.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        rest = share * (first["size"] or 0) - now["capped"]
        if now["free"] == 0 or (rest, now["free"]) == (left, free):
            break
        left, free = rest, now["free"]
    even = F.lit(left) * F.col("weight") / F.lit(free)
    return table.withColumn("target", F.when(even > cap, cap.cast("double")).otherwise(even))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    ceiling: int = CEILING,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: key, columns of ``keep``, source, size, source_size, target, copies."""
    sized = df.select(key, *keep, "source", word_count(F.col(text)).alias("size"))
    sized = stage(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stage(targets(sums, weights, share, ceiling), "targets")
    unit = 1 << UNIT_BITS
    planned = plan.select(
        "rank", F.col("source").alias("_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * unit))
        .otherwise(0).cast("bigint").alias("expected"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(unit)).alias("offset"),
    )
    order = ["rank", "size", key, *keep]
    joined = sized.join(planned, sized["source"].eqNullSafe(planned["_source"])).drop("_source")
    summed = prefix_sum(
        range_sorted(joined, order, "mix"), ["rank"], order[1:], F.col("expected"), "before"
    )
    begin = F.col("before") + F.col("offset")
    crossed = F.shiftright(begin + F.col("expected"), UNIT_BITS) - F.shiftright(begin, UNIT_BITS)
    return summed.select(
        key, *keep, "source", "size", "source_size", "target", crossed.alias("copies")
    )


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix(df, key, text).select(key, "size", "source_size", "target", taken)


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with their columns as they are.

    Rows that agree in every column are told apart by nothing, so they share the sum of their copies.
    """
    row_hash = F.xxhash64(*map(named, df.columns))
    hashed = df.select(key, text, "source", row_hash.alias("_row"))
    copies = (
        mix(hashed, key, text, keep=["_row"]).groupBy(F.col(key).alias("_key"), "_row")
        .agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    )
    rows = df.select(F.col(key).alias("_own"), row_hash.alias("_hash"), boxed(df).alias("_whole"))
    rows = rows.groupBy("_own", "_hash").agg(F.first("_whole").alias("_whole"))
    matched = rows.join(
        copies, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_row"))
    )
    return matched.select("_whole", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_whole.*")
