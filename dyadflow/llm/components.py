"""Connected components over pairs of ids, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.staging import narrowed, release, stage


def components(pairs: DataFrame) -> DataFrame:
    """(a, b) → (id, root): the smallest id reachable, for every id that occurs in a pair.

    Each round lets every id take the smallest root among its neighbours' roots, hands that to its
    own root, and shortcuts roots to their roots; trees at least halve their height, so the rounds
    grow with the logarithm of the longest path. Each round is written, so a lost executor replays
    one round only. Roots with many members make skewed join keys, but their other side is one row.
    """
    edges = stage(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(),
        "edges",
    )
    labels = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
                   .withColumnRenamed("a", "id"), "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("b"), F.col("root").alias("near")), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        )
        met = labels.drop("old").join(near, "id").select("id", "root", F.least("root", "near").alias("low"))
        # an id brings what it met to its root as well
        hooked = met.groupBy(F.col("root").alias("id")).agg(F.min("low").alias("hook"))
        lowered = stage(
            met.join(hooked, "id", "left").select(
                "id", F.col("root").alias("old"), F.least("low", F.coalesce("hook", "low")).alias("root")
            ),
            "lowered",
        )
        jump = lowered.select(F.col("id").alias("root"), F.col("root").alias("next"))
        earlier = labels
        labels = stage(
            lowered.join(jump, "root", "left").select(
                "id", "old", F.coalesce("next", "root").alias("root")
            ),
            "labels",
        )
        release(earlier, lowered)
        if not labels.where("old <> root").limit(1).count():
            release(edges)
            return narrowed(labels, "id", "root")
