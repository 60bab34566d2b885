"""Quantiles and column profiles that are kept per chunk and merged, so a new chunk costs one read of itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of a KLL sketch: the rank error stays well below 1 %, a sketch has a few kilobytes.
KLL_K = 800
# Size of a HyperLogLog sketch as a power of two: the relative error is near 0.8 %.
HLL_LG_K = 14


def quantile_sketches(df: DataFrame, value: str, chunk: Column) -> DataFrame:
    """One row per chunk (chunk, rows, sketch) over the values that are not NULL."""
    number = F.col(value).cast("double")
    return df.filter(number.isNotNull()).groupBy(chunk.alias("chunk")).agg(
        F.count("*").alias("rows"), F.kll_sketch_agg_double(number, KLL_K).alias("sketch")
    )


def merged_quantiles(sketches: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(fraction, quantile, rows) of all chunks together; a quantile is one of the values. Empty without chunks."""
    whole = sketches.agg(F.kll_merge_agg_double("sketch", KLL_K).alias("_all"), F.sum("rows").alias("rows"))
    entries = [
        F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_double("_all", F.lit(float(f))).alias("quantile"))
        for f in fractions
    ]
    return whole.filter("rows > 0").select(F.inline(F.array(*entries)), "rows").select("fraction", "quantile", "rows")


def partial_profile(df: DataFrame, columns: Sequence[str], chunk: Column) -> DataFrame:
    """Per chunk and column: rows, missing, least and greatest value and a sketch of the distinct values.

    Numbers are compared as numbers (``min_number``), everything else as text (``min_text``).
    """
    kinds = dict(df.dtypes)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    wide, entries = [F.count("*").alias("rows")], []
    for i, c in enumerate(columns):
        is_number = kinds[c].split("(")[0] in numeric
        number = F.col(c).cast("double") if is_number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_number else F.col(c).cast("string")
        parts = {
            "missing": F.count_if(F.col(c).isNull()),
            "min_number": F.min(number),
            "max_number": F.max(number),
            "min_text": F.min(text),
            "max_text": F.max(text),
            "sketch": F.hll_sketch_agg(F.col(c).cast("string"), HLL_LG_K),
        }
        wide += [v.alias(f"{name}_{i}") for name, v in parts.items()]
        entries.append(
            F.struct(F.lit(c).alias("column_name"), F.col("rows"), *[F.col(f"{n}_{i}").alias(n) for n in parts])
        )
    return df.groupBy(chunk.alias("chunk")).agg(*wide).select("chunk", F.inline(F.array(*entries)))


def merged_profile(partials: DataFrame) -> DataFrame:
    """The profile of all chunks, one row per column; distinct values are estimated."""
    return partials.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        F.round(F.try_divide(F.sum("missing") * F.lit(100.0), F.sum("rows")), 2).alias("missing_pct"),
        F.min("min_number").alias("min_number"),
        F.max("max_number").alias("max_number"),
        F.min("min_text").alias("min_text"),
        F.max("max_text").alias("max_text"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
    )
