"""The training-data pipeline: each stage works on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.decontamination import contamination
from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.near_duplicates import near_duplicates
from ledgerlens.llm.private_data import redact
from ledgerlens.llm.scratch import Scratch
from ledgerlens.llm.slots import may_hold
from ledgerlens.llm.toxicity import score_column, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(score_column(docs, model)(F.col("text")) < 0.5)


def _free_name(docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    return "_" * (1 + max(map(len, docs.columns)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Rows of equal doc_id and text are copies, of which one stays. Other rows of equal doc_id
    are one document. Rows without id take part under a number made from their text, above
    the other ids, so that a copy with an id is preferred.
    """
    key = _free_name(docs)
    nameless = F.xxhash64("text").bitwiseOR(1 << 62).bitwiseAND((1 << 63) - 1)
    numbered = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), nameless))
    gone = near_duplicates(numbered.select(F.col(key).alias("doc_id"), "text")).filter("NOT kept")
    # Only rows that repeat as a whole, and few others, meet their copies in a shuffle.
    row = key + "_"
    keyed = numbered.withColumn(row, F.xxhash64("doc_id", "text"))
    repeats = may_hold(keyed.groupBy(row).count().filter("count > 1"), row)
    rows = keyed.filter(~repeats(row)).unionByName(keyed.filter(repeats(row)).dropDuplicates([row]))
    return rows.join(gone.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a window of a benchmark item; each row is judged by its own text."""
    key = _free_name(docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = contamination(
        keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    gone = found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind; n_chars follows."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the temperature mix of the sources wants it."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("private_data", redact_private_data),
    ("mixing", mix),
]

# A trained classifier is not expressible in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is written to the shared folder and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
