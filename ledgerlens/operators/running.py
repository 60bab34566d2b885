"""Totals over everything strictly earlier in an order, for groups of any size.

A window partitioned by an entity puts all rows of that entity into one task. Here the
order is given as levels from coarse to fine, for example (hour slot, second). Rows are
first aggregated to *steps*, one per key and finest level, with map-side combining; then
each level has its own window that only spans one step of the level above. With hour
slots a window over seconds holds at most 3,600 rows and the window over slots one row
per hour, however many rows the entity has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_S = 3_600


def time_slot(ts: Column, seconds: int = SLOT_S) -> Column:
    return F.floor(ts / seconds).cast("long")


def id_levels(number: Column) -> list[Column]:
    """Coarse to fine ranges of a whole number by its bits.

    Below each other they hold at most 2^22, 2^21 and 2^21 steps, however the numbers lie.
    """
    return [F.shiftright(number.cast("long"), bits) for bits in (42, 21)]


def double_levels(number: Column) -> list[Column]:
    """Coarse to fine ranges of a double by its logarithm, whatever its scale.

    Below each other they hold at most about 2^22 steps: a coarse range spans a factor of 2^(1/1024),
    a fine one of 2^(1/2^31). The logarithm never falls where the number rises, so the order is kept.
    """
    # Above zero for every double; there is no logarithm of zero, which lies between both signs.
    size = F.log2(F.abs(number)) + F.lit(1100.0)
    return [F.coalesce(F.signum(number) * F.floor(size * F.lit(2.0**k)), F.lit(0.0)).cast("bigint") for k in (10, 31)]


def steps_of(
    df: DataFrame, keys: Sequence[str], levels: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """One row per key and finest level with the aggregated measures."""
    return df.groupBy(*keys, *levels).agg(*[agg.alias(name) for name, agg in measures.items()])


def prior_totals(
    steps: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
) -> DataFrame:
    """``steps`` plus ``prior_<name>``: sum (0 if none) or maximum (NULL if none) of all earlier steps.

    ``steps`` holds one row per (keys, levels); keys and levels are not NULL. All other
    columns are numbers and come back as doubles, exact for whole numbers below 2^53.
    """
    keys, levels = list(keys), list(levels)
    values = [c for c in steps.columns if c not in {*keys, *levels}]
    cells = _placed(steps, keys, levels, values)
    result = _earlier(cells, keys, levels, values, sums, maxes, "prior_", values)
    for depth in range(len(levels) - 1, 0, -1):
        upper = levels[:depth]
        totals = [F.sum(_value(values, c)).alias(c) for c in sums]
        totals += [F.max(_value(values, c)).alias(c) for c in maxes]
        values = [*sums, *maxes]
        # The cells already lie together by these columns, so this needs no shuffle.
        cells = _placed(cells.groupBy(*keys, *upper).agg(*totals), keys, upper, values)
        above = _earlier(cells, keys, upper, values, sums, maxes, "above_", [])
        merged = [(F.col(f"prior_{c}") + F.col(f"above_{c}")).alias(f"prior_{c}") for c in sums]
        # A NULL maximum means "none", and greatest() skips NULL.
        merged += [F.greatest(f"prior_{c}", f"above_{c}").alias(f"prior_{c}") for c in maxes]
        kept = [c for c in result.columns if c not in {f"prior_{name}" for name in values}]
        result = result.join(above, _sorted(keys, upper), "inner").select(*kept, *merged)
    return result


def _sorted(keys: list[str], levels: list[str]) -> list[str]:
    """Keys and levels as sort columns.

    Sorts compare the first column through its first 8 bytes alone and the next ones in
    turn, so a first key that tells entities apart and then the levels make most
    comparisons cheap.
    """
    return [*keys[:1], *levels, *keys[1:]]


def _placed(cells: DataFrame, keys: list[str], levels: list[str], values: list[str]) -> DataFrame:
    """Cells of one window side by side, their values packed in the array ``_m``.

    The window and the totals of the next level read the same shuffle. They use different
    values; packing keeps column pruning from turning that one shuffle into two.
    """
    packed = cells.select(*keys, *levels, F.array(*[F.col(c).cast("double") for c in values]).alias("_m"))
    together = [*keys, *levels[:-1]]
    return packed.repartition(*together) if together else packed


def _value(values: Sequence[str], name: str) -> Column:
    return F.col("_m")[list(values).index(name)]


def _earlier(
    cells: DataFrame,
    keys: list[str],
    levels: list[str],
    values: list[str],
    sums: Sequence[str],
    maxes: Sequence[str],
    prefix: str,
    keep: Sequence[str],
) -> DataFrame:
    """Totals of the earlier cells within one step of the level above."""
    frame = (
        Window.partitionBy(*_sorted(keys, levels[:-1]))
        .orderBy(levels[-1])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return cells.select(
        *keys,
        *levels,
        *[_value(values, c).alias(c) for c in keep],
        *[F.coalesce(F.sum(_value(values, c)).over(frame), F.lit(0.0)).alias(prefix + c) for c in sums],
        *[F.max(_value(values, c)).over(frame).alias(prefix + c) for c in maxes],
    )
