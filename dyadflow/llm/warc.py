"""Fixity audit of web archives: hash trees over records and ordered offset ranges.

Records of a replica are placed in archives at offsets. Each record is hashed; a leaf node hashes the
records that start in a range of ``SPAN`` bytes, in order of offset; a node above hashes ``FAN`` nodes.
The audit compares the roots of two replicas, then only the children of nodes that differ, down to the
records. A node's group is bounded by its range, so no group grows with the input.

Null fields count as empty, empty tables give no rows, repeated rows are records of their own, other
columns play no part. Everything is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.llm.ranges import prefix_sum, range_sorted
from dyadflow.staging import stage

ARCHIVE_BYTES = 1 << 26
SPAN = 1 << 16
FAN = 16
LEVELS = 4  # SPAN * FAN ** 3 covers an archive: the last level is its root


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record as a string; its bytes are its UTF-8."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def place(sizes: DataFrame, order: list[str], archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Append archive and offset to rows with ``length``, laid out in ``order``.

    A new archive begins with the first record that starts ``archive_bytes`` further on.
    """
    laid = prefix_sum(range_sorted(sizes, order, "laid"), [], order, F.col("length"), "_start")
    laid = laid.withColumn("archive", F.floor(F.col("_start") / archive_bytes))
    first = laid.groupBy("archive").agg(F.min("_start").alias("_first"))
    return (
        laid.join(first, "archive")
        .withColumn("offset", (F.col("_start") - F.col("_first")).cast("bigint"))
        .drop("_start", "_first", "_part", "_tie")
    )


def tree(leaves: DataFrame, name: str) -> list[DataFrame]:
    """(archive, offset, length, sha256) → written nodes (archive, node, hash), leaf level first."""

    def nodes(rows: DataFrame, node: Column, place: Column, text: Column) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(place.alias("place"), text.alias("text"))))
        joined = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
        return rows.groupBy("archive", node.cast("bigint").alias("node")).agg(F.sha2(joined, 256).alias("hash"))

    told = F.concat_ws(":", "offset", "length", "sha256")
    level = stage(nodes(leaves, F.floor(F.col("offset") / SPAN), F.col("offset"), told), f"{name}-0")
    levels = [level]
    for number in range(1, LEVELS):
        told = F.concat_ws(":", "node", "hash")
        level = stage(nodes(level, F.floor(F.col("node") / FAN), F.col("node"), told), f"{name}-{number}")
        levels.append(level)
    return levels


def _differing(a: DataFrame, b: DataFrame, within: DataFrame | None) -> DataFrame:
    """(archive, node) whose hashes differ or that only one replica has, below nodes in ``within``."""
    if within is not None:
        parent = F.floor(F.col("node") / FAN).cast("bigint").alias("_parent")
        above = within.select("archive", F.col("node").alias("_parent"))
        below = lambda nodes: nodes.select("*", parent).join(above, ["archive", "_parent"], "left_semi").drop("_parent")
        a, b = below(a), below(b)
    other = b.withColumnRenamed("hash", "_hash")
    return a.join(other, ["archive", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("_hash"))).select("archive", "node")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records (archive, offset, status) of two replicas that do not agree.

    Both are (archive, offset, length, sha256). ``status``: changed, missing (not in ``theirs``), extra.
    """
    a, b = tree(ours, "ours"), tree(theirs, "theirs")
    wrong = None
    for level in reversed(range(LEVELS)):
        wrong = stage(_differing(a[level], b[level], wrong), f"wrong-{level}")
    node = F.floor(F.col("offset") / SPAN).cast("bigint").alias("node")
    below = lambda rows: rows.select("*", node).join(wrong, ["archive", "node"], "left_semi")
    left = below(ours).select("archive", "offset", F.struct("length", "sha256").alias("_ours"))
    right = below(theirs).select("archive", "offset", F.struct("length", "sha256").alias("_theirs"))
    status = (
        F.when(F.col("_theirs").isNull(), "missing").when(F.col("_ours").isNull(), "extra").otherwise("changed")
    )
    return (
        left.join(right, ["archive", "offset"], "full")
        .where(~F.col("_ours").eqNullSafe(F.col("_theirs")))
        .select("archive", "offset", status.alias("status"))
    )


def report(pages: DataFrame, damaged: Column, lost: Column) -> DataFrame:
    """One row per page: where its record lies, its hash, and how the replica's record compares.

    The replica is made here: the records with one character of their body changed where ``damaged``
    holds, and without those where ``lost`` holds.
    """
    own = record(F.col("page_id"), F.col("url"), F.col("html"))
    html = F.coalesce(F.col("html"), F.lit(""))
    half = F.floor(F.length(html) / 2).cast("int")
    other = F.when(F.substring(html, half, 1) == "x", "y").otherwise("x")
    flipped = F.when(half > 0, F.overlay(html, other, half, 1)).otherwise("x")
    copied = F.when(
        F.coalesce(damaged, F.lit(False)), record(F.col("page_id"), F.col("url"), flipped)
    ).otherwise(own)
    hashed = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.octet_length(own).cast("bigint").alias("length"),
        F.sha2(own, 256).alias("sha256"), F.octet_length(copied).cast("bigint").alias("their_length"),
        F.sha2(copied, 256).alias("their_sha256"), F.coalesce(lost, F.lit(False)).alias("lost"),
    )
    placed = stage(place(stage(hashed, "records"), ["url", "page_id", "sha256"]), "placed")
    theirs = placed.where(~F.col("lost")).select(
        "archive", "offset", F.col("their_length").alias("length"), F.col("their_sha256").alias("sha256")
    )
    found = audit(placed.select("archive", "offset", "length", "sha256"), theirs)
    return placed.join(found, ["archive", "offset"], "left").select(
        "page_id", F.col("archive").cast("bigint").alias("archive"), "offset", "length", "sha256",
        F.coalesce("status", F.lit("intact")).alias("status"),
    )
