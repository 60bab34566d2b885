"""The tables of a data folder as the inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.keys import clean_key

# Second 0 of the events' own clock: 2024-01-01T00:00:00Z, a multiple of one day.
EVENTS_ANCHOR_S = 1_704_067_200


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as card transactions; some rows lack a device or an address."""
    # In a select of its own, the text of the properties is parsed once per row.
    events = table(spark, folder, "events").select("*", F.get_json_object("props", "$.k").alias("_device"))
    # The stored times have no zone; this difference does not depend on the session's zone.
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("transaction_id"),
        seconds.alias("ts"),
        F.col("value").alias("amount"),
        clean_key(F.col("user_id")).alias("card_key"),
        F.when(kind != "view", clean_key(F.col("_device"))).alias("device_key"),
        F.when(kind != "signup", clean_key(F.floor(F.col("user_id") / 2))).alias("addr_key"),
        (kind == "error").cast("int").alias("is_fraud"),
        F.least(F.lit(1.0), F.col("value") / 150).alias("risk_score"),
    )
