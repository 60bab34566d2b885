"""Scalar expressions over single rows: clock parts, bands, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400
HOUR_S = 3_600

# Unix second of 2017-12-01T00:00:00Z, second 0 of the dataset clock.
CLOCK_ANCHOR_S = 1_512_086_400

# Lowest score of each risk band.
BAND_FLOORS = {"CRITICAL": 0.85, "HIGH": 0.6, "MEDIUM": 0.3}
LOWEST_BAND = "LOW"


def hour_of(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(DAY_S)) / HOUR_S).cast("long")


def day_of(ts: Column) -> Column:
    return F.floor(ts / DAY_S).cast("long")


def dow_of(ts: Column) -> Column:
    return F.pmod(day_of(ts), F.lit(7)).cast("long")


def risk_band(score: Column, floors: dict[str, float] = BAND_FLOORS) -> Column:
    band = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, floor in sorted(floors.items(), key=lambda item: -item[1]):
        band = band.when(score >= floor, F.lit(name))
    return band.otherwise(F.lit(LOWEST_BAND))


def clamp_score(score: Column) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def log_amount(amount: Column) -> Column:
    return F.log1p(amount)


def flag_tf(flag: Column) -> Column:
    return F.when(flag == "T", 1.0).when(flag == "F", 0.0)


def clock_to_utc(ts: Column, anchor_s: int = CLOCK_ANCHOR_S) -> Column:
    """Instant of a second on the dataset clock."""
    return F.timestamp_seconds(ts + F.lit(anchor_s))


def utc_to_clock(at: Column, anchor_s: int = CLOCK_ANCHOR_S) -> Column:
    """Whole second on the dataset clock of an instant; accepts zone-less UTC timestamps."""
    return F.unix_seconds(at.cast("timestamp")) - F.lit(anchor_s)


def label_boundary(as_of: Column, lag_days: int, anchor_s: int = CLOCK_ANCHOR_S) -> Column:
    """Latest arrival instant of a label that may be used at ``as_of``."""
    return clock_to_utc(as_of - F.lit(lag_days * DAY_S), anchor_s)


def label_is_eligible(arrival: Column, as_of: Column, lag_days: int) -> Column:
    """Arrival and query on the dataset clock; the boundary itself is eligible."""
    return arrival <= as_of - F.lit(lag_days * DAY_S)
