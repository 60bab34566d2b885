"""Fixed schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Numeric and text columns of the transaction and identity files.
_COUNTS = [f"C{i}" for i in range(1, 15)]
_DELAYS = [f"D{i}" for i in range(1, 16)]
_MATCHES = [f"M{i}" for i in range(1, 10)]
_VALUES = [f"V{i}" for i in range(1, 340)]
_ID_NUMBERS = [f"id_{i:02d}" for i in range(1, 12)]
_ID_TEXTS = [f"id_{i:02d}" for i in range(12, 39)]


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind, True) for n in names]


TRANSACTION = T.StructType(
    _fields(T.LongType(), "TransactionID")
    + _fields(T.IntegerType(), "isFraud")
    + _fields(T.LongType(), "TransactionDT")
    + _fields(T.DoubleType(), "TransactionAmt")
    + _fields(T.StringType(), "ProductCD")
    + _fields(T.DoubleType(), "card1", "card2", "card3")
    + _fields(T.StringType(), "card4")
    + _fields(T.DoubleType(), "card5")
    + _fields(T.StringType(), "card6")
    + _fields(T.DoubleType(), "addr1", "addr2", "dist1", "dist2")
    + _fields(T.StringType(), "P_emaildomain", "R_emaildomain")
    + _fields(T.DoubleType(), *_COUNTS, *_DELAYS)
    + _fields(T.StringType(), *_MATCHES)
    + _fields(T.DoubleType(), *_VALUES)
)

IDENTITY = T.StructType(
    _fields(T.LongType(), "TransactionID")
    + _fields(T.DoubleType(), *_ID_NUMBERS)
    + _fields(T.StringType(), *_ID_TEXTS, "DeviceType", "DeviceInfo")
)

LINKS = T.StructType(
    _fields(T.StringType(), "entity_type", "entity_key") + _fields(T.LongType(), "transaction_id", "ts")
)

SCORES = T.StructType(
    _fields(T.LongType(), "transaction_id")
    + _fields(T.DoubleType(), "risk_score")
    + _fields(T.StringType(), "risk_band")
    + _fields(T.TimestampType(), "scored_at")
    + _fields(T.StringType(), "model_version")
)

EVIDENCE = T.StructType(
    _fields(T.LongType(), "transaction_id")
    + _fields(
        T.StringType(), "evidence_type", "severity", "title", "description", "details", "provenance",
        "evidence_id", "evidence_hash",
    )
)
