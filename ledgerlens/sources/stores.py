"""Stored tables that take new rows without being rewritten, and imports that keep their rejects."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ledgerlens.sources.tables import append_if_absent, replace_version, upsert_by_key

BUCKET = "_bucket"
REJECTED = "_rejected"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_store(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Store ``df`` in one folder per hash bucket of its keys; later calls must pass the same number of buckets."""
    df.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_store(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(_with_bucket(schema)).parquet(path).drop(BUCKET)


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(BUCKET, IntegerType())])


def _merge(
    incoming: DataFrame, path: str, keys: Sequence[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> list[int]:
    """Merge ``incoming`` into the buckets it touches, and into no others.

    Only the numbers of touched buckets come to the driver. New files are written beside the old ones
    and take their place when all tasks are done, so a lost executor repeats its tasks and nothing else.
    """
    placed = incoming.withColumn(BUCKET, _bucket(keys, buckets))
    touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())
    if touched:
        old = incoming.sparkSession.read.schema(_with_bucket(incoming.schema)).parquet(path)
        merged = merge(old.filter(F.col(BUCKET).isin(touched)).drop(BUCKET), incoming)
        replace_version(merged.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET), path, BUCKET)
    return touched


def upsert_into_store(incoming: DataFrame, path: str, keys: Sequence[str], recency: str, buckets: int) -> list[int]:
    """``upsert_by_key`` on a store; returns the buckets that were rewritten. Columns are those of the store."""
    return _merge(incoming, path, keys, buckets, lambda old, new: upsert_by_key(old, new, keys, recency))


def append_into_store(incoming: DataFrame, path: str, key: str, buckets: int) -> list[int]:
    """``append_if_absent`` on a store; returns the buckets that were rewritten."""
    return _merge(incoming, path, [key], buckets, lambda old, new: append_if_absent(old, new, key))


def read_csv_with_rejects(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the others: their text and what could be read of them.

    A row is rejected if it has too few or too many cells, or a cell that is not of its type.
    """
    wide = StructType([*schema.fields, StructField(REJECTED, StringType())])
    rows = (
        spark.read.option("columnNameOfCorruptRecord", REJECTED).option("columnPruning", "false")
        .csv(path, schema=wide, header=True, mode="PERMISSIVE")
    )
    # Spark refuses plans that read nothing but the rejected text, such as a count; this reads a column too.
    text = F.concat(F.col(REJECTED), F.coalesce(F.col(schema.names[0]).cast("string"), F.lit("")))
    good = rows.filter(text.isNull()).drop(REJECTED)
    bad = rows.filter(text.isNotNull()).select(REJECTED, F.struct(*schema.names).alias("parsed"))
    return good, bad


def read_ages(spark: SparkSession, path: str, wanted: StructType) -> DataFrame:
    """Stored files of several ages under one schema: columns a file does not have are NULL.

    The wanted columns come first; columns that only files know follow.
    """
    found = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    known = [
        (F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields
    ]
    return found.select(*known, *[c for c in found.columns if c not in wanted.names])
