"""Reading and writing the tables, and merging new rows into stored ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_typed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header and a fixed schema; a row that does not fit fails the read."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def csv_to_parquet(spark: SparkSession, path: str, schema: StructType, out: str) -> DataFrame:
    """Convert a CSV file to snappy parquet and return the written table."""
    read_typed_csv(spark, path, schema).write.mode("overwrite").option("compression", "snappy").parquet(out)
    return spark.read.schema(schema).parquet(out)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def align_schema(stored: DataFrame, newer: DataFrame) -> DataFrame:
    """Both tables as one; columns missing on either side are NULL there."""
    return stored.unionByName(newer, allowMissingColumns=True)


def upsert_by_key(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], recency: str) -> DataFrame:
    """Stored rows replaced by incoming rows of the same key; of several incoming, the latest.

    An aggregate rather than a window, so copies of one key are combined before the shuffle.
    """
    rest = [c for c in stored.columns if c not in keys]
    marked = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest = F.max(F.struct("_new", recency, F.struct(*rest).alias("row"))).alias("m")
    return marked.groupBy(*keys).agg(latest).select(*keys, "m.row.*").select(*stored.columns)


def append_if_absent(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows plus incoming rows with new keys; of copies of a new key, the smallest row."""
    rest = [c for c in stored.columns if c != key]
    fresh = (
        incoming.join(stored.select(key), key, "left_anti")
        .groupBy(key)
        .agg(F.min(F.struct(*rest)).alias("r"))
        .select(key, "r.*")
    )
    return stored.unionByName(fresh.select(*stored.columns))


def replace_version(scores: DataFrame, path: str, column: str = "model_version") -> None:
    """Write scores; stored rows of the same versions are replaced, other versions stay."""
    (
        scores.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a hash of the content that does not depend on the order of rows.

    A row is the text of its columns by name, each as length:text or - if missing. The first
    15 hex digits of its MD5 are summed up, so any engine can repeat it.
    """
    cells = []
    for c in sorted(df.columns):
        text = F.col(c).cast("string")
        cells.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    digest = F.conv(F.substring(F.md5(F.concat(*cells)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("content"))
