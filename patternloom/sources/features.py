"""Feature tables from the star schema, the event stream and the corpus.

Money enters sums as whole cents, so that no result depends on the order in
which partitions are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.functions import vectors as V

CUSTOMER_FEATURES = ("recency_days", "purchase_frequency", "avg_order_value", "discount_ratio", "balance", "product_diversity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders: (row_id, segment, the CUSTOMER_FEATURES as doubles).

    Lines are summed per order before they meet customers, so the large join is
    on the order key alone and the customer side is one row each.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(cents(F.col("l_discount"))).alias("discount"), F.count(F.lit(1)).alias("lines"), F.collect_set("l_partkey").alias("parts")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    last = orders.agg(F.max("day").alias("last_day"))
    per = orders.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("day").alias("day"),
        F.count(F.lit(1)).alias("n"),
        F.sum(cents(F.col("o_totalprice"))).alias("spent"),
        F.sum("discount").alias("discount"),
        F.sum("lines").alias("lines"),
        F.size(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("parts"),
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    lines_or_null = F.nullif(F.col("lines"), F.lit(0)).cast("double")
    return per.join(customers, "c_custkey").crossJoin(F.broadcast(last)).select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_mktsegment").alias("segment"),
        F.datediff("last_day", "day").cast("double").alias("recency_days"),
        F.col("n").cast("double").alias("purchase_frequency"),
        (F.col("spent") / 100.0 / F.col("n")).alias("avg_order_value"),
        F.coalesce(F.col("discount") / 100.0 / lines_or_null, F.lit(0.0)).alias("discount_ratio"),
        F.col("c_acctbal").cast("double").alias("balance"),
        F.coalesce(F.col("parts") / lines_or_null, F.lit(0.0)).alias("product_diversity"),
    )


def sensor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and hour: (user_id, hour, n_events, value_mean, value_max, error_ratio)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("n_events"),
        (F.sum(cents(F.col("value"))) / 100.0 / F.count(F.lit(1))).alias("value_mean"),
        F.max("value").alias("value_max"),
        (F.sum((F.col("event_type") == "error").cast("long")) / F.count(F.lit(1))).alias("error_ratio"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, interaction_strength): the quantity of each part that each customer bought."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, "o_orderkey").groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(
        F.sum("l_quantity").cast("double").alias("interaction_strength")
    )


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as (id, x array<double>, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("x"), "label")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as (id, score, is_anomaly, event_type)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_anomaly"), "event_type"
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, pos, v): each event type's mean value per day, from day 0."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("pos")).agg(
        (F.sum(cents(F.col("value"))) / 100.0 / F.count(F.lit(1))).alias("v")
    )


def hourly_series(spark: SparkSession, sf_dir: str, step_hours: int = 6) -> DataFrame:
    """(pos, v): the mean event value of every `step_hours` hours that have events, numbered in order of time."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    bucket = F.floor(seconds / (3600 * step_hours)).cast("long")
    first = F.lit(1704067200 // (3600 * step_hours))
    return table(spark, sf_dir, "events").groupBy((bucket - first).alias("pos")).agg((F.sum(cents(F.col("value"))) / 100.0 / F.count(F.lit(1))).alias("v"))
