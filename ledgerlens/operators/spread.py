"""Joins of a table with hot keys to a table with few rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys with more rows than this are split into pieces of about this size.
HOT_ROWS = 1_000_000

# The most frequent keys looked at, per shuffle partition. Any other key holds less than a
# quarter of a mean partition, so splitting it gains nothing, whatever the size of the table.
KEYS_PER_PARTITION = 4


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of pieces, a few per shuffle partition."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_rows"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        counts.filter(F.col("_rows") > hot_rows)
        .orderBy(F.desc("_rows"))
        .limit(KEYS_PER_PARTITION * partitions)
        .select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_pieces"))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    by: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left.join(right, on, how)`` with the hot keys of ``left`` split over many tasks.

    ``by`` names the columns of ``left`` whose hash picks the piece (default: all).
    ``right`` rows of a hot key are repeated once per piece. ``how``: inner, left,
    left_semi or left_anti.

    One job counts the keys of ``left`` and brings back the few hot ones, so the plan
    holds ``left`` once and chains of such joins grow by one input each. Rows with a NULL
    key match nothing and go to any piece.
    """
    on = list(on)
    hot = hot_keys(left, on, hot_rows)
    found = hot.collect()  # at most KEYS_PER_PARTITION per shuffle partition
    if not found:
        return left.join(right, on, how)
    known = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    by = list(by or left.columns)
    pieces = F.coalesce("_pieces", F.lit(1))
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    spread = F.when(missing, F.lit(max(r["_pieces"] for r in found))).otherwise(pieces)
    left_salted = (
        left.join(known, on, "left")
        .withColumn("_piece", F.pmod(F.xxhash64(*by), spread).cast("int"))
        .drop("_pieces")
    )
    right_salted = (
        right.join(known, on, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_pieces")
    )
    return left_salted.join(right_salted, [*on, "_piece"], how).drop("_piece")
