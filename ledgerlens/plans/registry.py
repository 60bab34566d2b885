"""Named queries over a data folder and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The events as transactions, for the SQL side.
TXN = """txn AS (
  SELECT event_id AS transaction_id,
         CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS ts,
         value AS amount,
         CAST(user_id AS VARCHAR) AS card_key,
         CASE WHEN event_type <> 'view' THEN regexp_extract(props, '"k": *([0-9]+)', 1) END AS device_key,
         CASE WHEN event_type <> 'signup' THEN CAST(user_id // 2 AS VARCHAR) END AS addr_key,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
         least(CAST(1 AS DOUBLE), value / 150) AS risk_score,
         event_type
  FROM events)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``{TXN}`` in the SQL stands for the transactions above."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.replace("{TXN}", TXN)
        return fn

    return register


def r6(value: Column) -> Column:
    """Rounded for comparison; the shift keeps exact ties away from the rounding edge."""
    return F.round(value.cast("double") + F.lit(1e-9), 6)
