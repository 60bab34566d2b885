"""Profiles of tables and of the label over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import DAY_S, day_of, hour_of
from ledgerlens.operators.running import prior_totals, steps_of


def profile_columns(df: DataFrame, distinct: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Rows, missing count and share per column; distinct values of the chosen columns."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{i}") for i, c in enumerate(df.columns)],
        *[count(F.col(c)).alias(f"distinct_{i}") for i, c in enumerate(df.columns) if c in distinct],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("rows").alias("rows"),
            F.col(f"missing_{i}").alias("missing"),
            F.round(F.try_divide(F.col(f"missing_{i}") * F.lit(100.0), F.col("rows")), 2).alias("missing_pct"),
            (F.col(f"distinct_{i}") if c in distinct else F.lit(None)).cast("long").alias("distinct_values"),
        )
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*entries)))


def profile_labels(df: DataFrame, row_id: str, ts: str, label: str) -> DataFrame:
    """Duplicate ids, label sum and rate, first and last second and their distance in days."""
    return df.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct(row_id)).alias("duplicate_ids"),
        F.sum(label).alias("positives"),
        F.round(F.avg(label) * 100, 4).alias("positive_pct"),
        F.min(ts).alias("ts_min"),
        F.max(ts).alias("ts_max"),
        F.round((F.max(ts) - F.min(ts)) / float(DAY_S), 2).alias("span_days"),
    )


def daily_profile(df: DataFrame, ts: str, label: str) -> DataFrame:
    return (
        df.groupBy(day_of(F.col(ts)).alias("day"))
        .agg(F.count("*").alias("rows"), F.sum(label).alias("positives"))
        .select(
            "day",
            "rows",
            "positives",
            (F.col("positives") / F.col("rows")).alias("rate"),
            F.pmod(F.col("day"), F.lit(7)).alias("dow"),
        )
    )


def hourly_profile(df: DataFrame, ts: str, label: str) -> DataFrame:
    return (
        df.groupBy(hour_of(F.col(ts)).alias("hour"))
        .agg(F.count("*").alias("rows"), F.sum(label).alias("positives"))
        .withColumn("rate", F.col("positives") / F.col("rows"))
    )


def hourly_extremes(df: DataFrame, ts: str, label: str) -> DataFrame:
    """Hours with the lowest and the highest rate; the earlier hour wins ties."""
    return hourly_profile(df, ts, label).agg(
        F.min("rate").alias("min_rate"),
        F.min_by("hour", F.struct("rate", "hour")).alias("min_hour"),
        F.max("rate").alias("max_rate"),
        F.min_by("hour", F.struct(-F.col("rate"), F.col("hour"))).alias("max_hour"),
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    fractions: Sequence[float],
    by: Sequence[str] = (),
    levels: Sequence[Column] = (),
) -> DataFrame:
    """Linear-interpolated quantiles (by.., fraction, quantile) over all values.

    Values are counted per distinct value, and positions found through running totals
    over ``levels`` (coarse to fine expressions of the value), so no task sees them all.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    present = df.filter(F.col(value).isNotNull())
    keyed = present.select(*by, F.col(value).cast("double").alias("_value"), *[e.alias(n) for e, n in zip(levels, names)])
    order = [*names, "_value"]
    counted = prior_totals(steps_of(keyed, by, order, {"n": F.count("*")}), by, order, sums=("n",))
    sizes = present.groupBy(*by).agg(F.count("*").alias("_size"))
    wanted = sizes.select(*by, "_size", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    exact = F.col("fraction") * (F.col("_size") - 1)
    places = wanted.select(*by, "fraction", exact.alias("_at"), F.floor(exact).alias("_low"), F.ceil(exact).alias("_high"))
    # The places are few (fractions per group); Spark sends them to the counted values if small.
    hit = (F.col("prior_n") <= F.col("_high")) & (F.col("prior_n") + F.col("n") > F.col("_low"))
    spans = _within(counted, places, by, hit)
    low_here = (F.col("prior_n") <= F.col("_low")) & (F.col("_low") < F.col("prior_n") + F.col("n"))
    high_here = (F.col("prior_n") <= F.col("_high")) & (F.col("_high") < F.col("prior_n") + F.col("n"))
    ends = spans.groupBy(*by, "fraction").agg(
        F.max(F.when(low_here, F.col("_value"))).alias("_a"),
        F.max(F.when(high_here, F.col("_value"))).alias("_b"),
        F.max(F.col("_at") - F.col("_low")).alias("_part"),
    )
    return ends.select(*by, "fraction", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile"))


def _within(counted: DataFrame, places: DataFrame, by: Sequence[str], hit: Column) -> DataFrame:
    """Counted values that hold one of the places, matched by group.

    The places of a group become one array: one row per group to join to, or one value for
    the whole table. Each counted value keeps the few places that fall on it.
    """
    spots = places.groupBy(*by).agg(F.collect_list(F.struct("fraction", "_at", "_low", "_high")).alias("_spots"))
    if by:
        joined = counted.join(spots, list(by), "inner")
    else:
        joined = counted.withColumn("_spots", spots.scalar())
    return joined.select(*by, "_value", "n", "prior_n", F.inline("_spots")).filter(hit)
