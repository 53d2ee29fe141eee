"""Idempotent writes: pure upserts, and a Parquet folder that takes them bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadflow.staging import stage


def _first_per_key(rows: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """First row of each key in ``order``, ties by content; the top-1 is applied before the shuffle too."""
    line = Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*rows.columns))
    return rows.withColumn("_r", F.row_number().over(line)).where("_r = 1").drop("_r")


def latest(updates: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last row of each key; rows that tie in ``seq`` are told apart by a hash of their content."""
    return _first_per_key(updates, keys, F.desc(seq))


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Replace by key, last update wins; rows of other keys stay."""
    newest = latest(updates, keys, seq).drop(*([] if seq in base.columns else [seq]))
    kept = base.join(updates.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(newest).select(*base.columns)


def insert_ignore(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows whose key is not there yet, once each."""
    fresh = _first_per_key(rows.join(base.select(*keys), list(keys), "left_anti"), keys)
    return base.unionByName(fresh).select(*base.columns)


def upsert_extractions(base: DataFrame, updates: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Completed extractions replace by key; failed ones are always kept as they come."""
    done = F.col("status") == "completed"
    failed = updates.where(~done).drop(*([] if seq in base.columns else [seq]))
    merged = upsert(base.where(done), updates.where(done), keys, seq)
    return merged.unionByName(base.where(~done)).unionByName(failed)


def claim_keys(claims: DataFrame) -> DataFrame:
    """Add the key part that makes a missing timestamp comparable."""
    return claims.withColumn("timestamp_key", F.coalesce("timestamp_seconds", F.lit(-1)))


class KeyedTable:
    """A Parquet folder partitioned by a hash of the key.

    A write reads, merges and replaces only the buckets its rows fall into (dynamic partition
    overwrite, committed by Spark at the end of the job); the others are not touched. It takes one writer
    at a time: where several write, use a catalog table and ``MERGE``. ``buckets`` must not change.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:  # nothing was written yet
            return None

    def read(self) -> DataFrame:
        found = self._stored()
        if found is None:
            raise FileNotFoundError(self.path)
        return found.drop("_bucket")

    def _merge(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], drop: Sequence[str]) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        changes = stage(rows.withColumn("_bucket", bucket), "changes")
        # as many numbers as there are buckets, at most
        touched = [r["_bucket"] for r in changes.select("_bucket").distinct().collect()]
        found = self._stored()
        base = changes.drop(*drop).limit(0) if found is None else found.where(F.col("_bucket").isin(touched))
        merged = stage(merge(base, changes), "merged")  # what is overwritten may not be read meanwhile
        (
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("_bucket").parquet(self.path)
        )

    def upsert(self, updates: DataFrame, seq: str) -> None:
        self._merge(updates, lambda base, new: upsert(base, new, self.keys, seq), [seq])

    def insert_ignore(self, rows: DataFrame) -> None:
        self._merge(rows, lambda base, new: insert_ignore(base, new, self.keys), [])
