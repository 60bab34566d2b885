"""Membership filters of a fixed size for keys of tables of any size.

A bitmap of 2^SLOT_BITS slots is filled by an aggregation, so at most 2^SLOT_BITS / 64 rows
reach the driver and what is broadcast never grows with the data. A row whose slot is empty
is certainly not wanted; the others are settled by the join that follows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 24


def slots_of(keys: DataFrame, key: str) -> np.ndarray:
    """The bitmap of the slots of ``key``, a non-null column of hashes (long)."""
    top = F.shiftrightunsigned(key, 64 - SLOT_BITS)
    rows = (
        keys.groupBy(F.shiftright(top, 6).cast("int").alias("place"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (top % 64).cast("int"))).alias("bits"))
        .collect()
    )
    bits = np.zeros((1 << SLOT_BITS) // 64, dtype=np.int64)
    for row in rows:
        bits[row["place"]] = row["bits"]
    return bits.view(np.uint64)


def has_slot(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - SLOT_BITS)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def may_hold(wanted: DataFrame, column: str) -> Callable[[str], Column]:
    """A filter that lets through every value of ``wanted[column]`` (long) and few others."""
    bits = slots_of(wanted.filter(F.col(column).isNotNull()).select(F.xxhash64(column).alias("hash")), "hash")
    shared = wanted.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(has_slot(shared.value, hashes.to_numpy(dtype=np.int64).view(np.uint64)))

    return lambda name: test(F.xxhash64(name))
