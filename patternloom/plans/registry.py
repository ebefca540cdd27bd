"""The register, and SQL for the feature tables that queries start from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    """Register a query; without SQL where it is trained or iterates until it settles."""
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double of `df` rounded, so that the order of a sum does not show."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def rounded_sql(sql: str, columns: Sequence[str], digits: int = 6) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0e0 AS {c}' for c in columns)}) FROM ({sql})"


RFM = """SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS day, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS spent FROM orders GROUP BY 1"""
FEATURES = f"""SELECT c_custkey AS row_id, c_mktsegment AS segment,
  CAST(date_diff('day', day, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS DOUBLE) AS recency_days, CAST(n AS DOUBLE) AS purchase_frequency, spent / 100e0 / n AS avg_order_value,
  coalesce(discount / 100e0 / lines, 0e0) AS discount_ratio, c_acctbal AS balance, coalesce(parts / CAST(lines AS DOUBLE), 0e0) AS product_diversity
FROM customer JOIN ({RFM}) ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS k, sum(CAST(round(l_discount * 100) AS BIGINT)) AS discount, count(*) AS lines, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON k = c_custkey"""
MEAN = "sum(CAST(round(value * 100) AS BIGINT)) / 100e0 / count(*)"
HOURS = f"""SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n_events, {MEAN} AS value_mean, max(value) AS value_max,
  count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) AS error_ratio FROM events GROUP BY 1, 2"""
MATRIX = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings"
SCORES = "SELECT event_id AS id, value AS score, event_type = 'error' AS is_anomaly, event_type FROM events"
DAILY = f"SELECT event_type AS series_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS pos, {MEAN} AS v FROM events GROUP BY 1, 2"
HOURLY = f"SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) - 78892 AS pos, {MEAN} AS v FROM events GROUP BY 1"
