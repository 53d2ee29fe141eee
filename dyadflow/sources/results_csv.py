"""Hand-made result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadflow.functions import vocab


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Raw result rows, all text, with ``batch_key`` naming the file by its whole path.

    ``file_block`` is where the part of the file begins that a row was read from. The header of every file must be exactly the expected one; a file with another header fails
    the read. A line with the wrong number of columns is kept in ``_corrupt``.
    """
    fields = ", ".join(f"`{c}` string" for c in vocab.RESULT_COLUMNS)
    rows = (
        spark.read.schema(f"{fields}, _corrupt string")
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("escape", '"')
        .csv(path)
    )
    return rows.select(
        F.concat(F.lit("manual-results:"), F.col("_metadata.file_path")).alias("batch_key"),
        F.col("_metadata.file_block_start").alias("file_block"), "*",
    )


def check_header(spark: SparkSession, path: str) -> None:
    """Compare the first line of each file with the expected header before anything is parsed."""
    expected = ",".join(vocab.RESULT_COLUMNS)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
        "value",
    )
    first = lines.groupBy("file").agg(
        F.min_by("value", F.struct("start", "n")).alias("header")
    )
    wrong = first.where(F.col("header") != expected)
    number = wrong.count()
    if number:
        some = [r["file"] for r in wrong.orderBy("file").limit(20).collect()]
        raise ValueError(f"invalid CSV header in {number} files, first of them {some}: want {expected}")


def with_row_numbers(rows: DataFrame) -> DataFrame:
    """Line number of each row of ``read_results`` in its file; the first row after the header is 2.

    Rows are counted by part of a file in one pass and numbered within their part in another, so a large
    file is read in as many tasks as it has parts, and no task orders more than one part.
    """
    part = ["batch_key", "file_block"]
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("batch_key").orderBy("file_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*part, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*part).orderBy("_id")
    numbered = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(within))
    kept = [c for c in rows.columns if c != "file_block"]
    return numbered.join(before, part).select(*kept, (F.col("_before") + F.col("_n") + 1).alias("row_number"))
