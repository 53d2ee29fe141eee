"""Contests, ledgers and evidence derived from the driver's tables, in Spark and in SQL.

Every fixture is a pure function of whole input tables, in integer arithmetic, so both engines
agree. The SQL text of a fixture is a chain of common table expressions to put in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadflow.operators.dyads import derive_results


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dyads(spark: SparkSession, sf: str) -> DataFrame:
    """Every contest, completed or not: the first two suppliers of each order."""
    per_supplier = (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_suppkey", "l_quantity")
        .repartition("l_orderkey")  # once for all three steps, which each keep to an order
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.sum("l_quantity").alias("score"))
    )
    rank = Window.partitionBy("l_orderkey").orderBy(
        (F.col("l_suppkey") * 7919 + F.col("l_orderkey") * 104729) % 1009, "l_suppkey"
    )
    pairs = (
        per_supplier.withColumn("_r", F.row_number().over(rank))
        .where("_r <= 2")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("athlete_a_id"),
            F.max("l_suppkey").alias("athlete_b_id"),
            F.min_by("score", "l_suppkey").alias("score_a"),
            F.max_by("score", "l_suppkey").alias("score_b"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where("_n = 2")
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    status = F.when(F.col("score_a") == F.col("score_b"), "no_contest").otherwise("completed")
    joined = (
        pairs.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("status", status)
    )
    result_a, _ = derive_results(F.col("score_a"), F.col("score_b"), F.col("status"))
    return joined.select(
        F.col("o_orderkey").alias("match_id"),
        (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("event_id"),
        F.trunc("o_orderdate", "quarter").alias("held_on"),
        F.col("o_orderdate").cast("timestamp").alias("scheduled_at"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "left")
        .otherwise("right")
        .alias("arm"),
        F.col("c_mktsegment").alias("weight_class"),
        "athlete_a_id",
        "athlete_b_id",
        F.col("score_a").cast("int").alias("score_a"),
        F.col("score_b").cast("int").alias("score_b"),
        "status",
        result_a.alias("result_a"),
    )


def completed(spark: SparkSession, sf: str) -> DataFrame:
    return dyads(spark, sf).where("status = 'completed'").drop("score_a", "score_b", "status")


DYADS = """
per_supplier AS (
  SELECT l_orderkey, l_suppkey, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY (l_suppkey * 7919 + l_orderkey * 104729) % 1009, l_suppkey) AS r FROM per_supplier),
pairs AS (
  SELECT l_orderkey, min(l_suppkey) AS athlete_a_id, max(l_suppkey) AS athlete_b_id,
    arg_min(score, l_suppkey) AS score_a, arg_max(score, l_suppkey) AS score_b
  FROM ranked WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2),
dyads AS (
  SELECT o_orderkey AS match_id,
    CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS event_id,
    CAST(date_trunc('quarter', o_orderdate) AS DATE) AS held_on,
    CAST(o_orderdate AS TIMESTAMP) AS scheduled_at,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'left' ELSE 'right' END AS arm,
    c_mktsegment AS weight_class, athlete_a_id, athlete_b_id,
    CAST(score_a AS INTEGER) AS score_a, CAST(score_b AS INTEGER) AS score_b,
    CASE WHEN score_a = score_b THEN 'no_contest' ELSE 'completed' END AS status,
    CASE WHEN score_a > score_b THEN 'win' WHEN score_b > score_a THEN 'loss'
      ELSE 'no_contest' END AS result_a
  FROM pairs JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
matches AS (SELECT * FROM dyads WHERE status = 'completed')
""".strip()

SIDES = """
sides AS (
  SELECT match_id, event_id, scheduled_at, 'a' AS side, athlete_a_id AS athlete_id,
    athlete_b_id AS opponent_id, CASE WHEN result_a = 'win' THEN 1.0 ELSE 0.0 END::DOUBLE AS won
  FROM matches
  UNION ALL
  SELECT match_id, event_id, scheduled_at, 'b', athlete_b_id, athlete_a_id,
    CASE WHEN result_a = 'win' THEN 0.0 ELSE 1.0 END::DOUBLE FROM matches)
""".strip()


def with_ctes(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + query
