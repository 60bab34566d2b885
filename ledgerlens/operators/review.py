"""The review queue and the look-ups around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def queue_filters(
    scores: DataFrame,
    min_score: float | None = None,
    band: str | None = None,
    has_evidence: bool | None = None,
) -> DataFrame:
    """Filters of the queue; the stored band is compared without regard to case."""
    out = scores
    if min_score is not None:
        out = out.filter(F.col("risk_score") >= min_score)
    if band is not None:
        out = out.filter(F.upper("risk_band") == band.upper())
    if has_evidence is not None:
        out = out.filter(F.col("has_evidence") == has_evidence)
    return out


def with_evidence_flag(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """``has_evidence`` per scored transaction."""
    ids = evidence.select("transaction_id").distinct().withColumn("_has", F.lit(True))
    return scores.join(ids, "transaction_id", "left").withColumn(
        "has_evidence", F.coalesce("_has", F.lit(False))
    ).drop("_has")


def risk_queue(
    scores: DataFrame,
    evidence: DataFrame,
    limit: int = 25,
    min_score: float | None = None,
    band: str | None = None,
    has_evidence: bool | None = None,
) -> DataFrame:
    """The riskiest transactions, at most 200, with their evidence flag."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie between 1 and 200")
    early = queue_filters(scores, min_score, band)
    order = [F.desc("risk_score"), F.asc("transaction_id")]
    if has_evidence is None:
        # The flag changes nothing about who is in the queue, so it is looked up last.
        top = early.orderBy(*order).limit(limit)
        return with_evidence_flag(top, evidence).orderBy(*order)
    flagged = early.join(
        evidence.select("transaction_id").distinct(),
        "transaction_id",
        "left_semi" if has_evidence else "left_anti",
    )
    return flagged.withColumn("has_evidence", F.lit(has_evidence)).orderBy(*order).limit(limit)


def top_by_score(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("risk_score"), F.asc("transaction_id")).limit(k)


def latest_scores(scores: DataFrame) -> DataFrame:
    """One score per transaction: that of the latest ``scored_at``, then of the highest version."""
    rest = F.struct("model_version", "risk_score", "risk_band", "scored_at")
    return scores.groupBy("transaction_id").agg(
        F.max_by(rest, F.struct("scored_at", "model_version")).alias("s")
    ).select("transaction_id", "s.*")


def scores_for(ids: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the listed transactions."""
    return scores.join(ids.select("transaction_id").distinct(), "transaction_id", "left_semi")


def lookup(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (one column of that name)."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def coverage_status(ids: DataFrame, raw: DataFrame, base: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """404 for unknown ids, 422 for known ids without features, 200 for covered ids."""
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(True))

    joined = (
        ids.select(key)
        .join(flag(raw, "_raw"), key, "left")
        .join(flag(base, "_base"), key, "left")
        .join(flag(features, "_features"), key, "left")
    )
    status: Column = (
        F.when(F.col("_raw").isNull(), 404)
        .when(F.col("_base").isNull() | F.col("_features").isNull(), 422)
        .otherwise(200)
    )
    return joined.select(key, status.alias("status"))


def investigation_ready(
    transactions: DataFrame, scores: DataFrame, evidence: DataFrame, links: DataFrame
) -> DataFrame:
    """Does a transaction have a score, evidence and links."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("transaction_id").agg(F.count("*").alias(name))

    joined = transactions.select("transaction_id")
    for df, name in ((scores, "scores"), (evidence, "evidence"), (links, "links")):
        joined = joined.join(counted(df, name), "transaction_id", "left")
    names = ("scores", "evidence", "links")
    out = joined.select("transaction_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("ready", (F.col("scores") > 0) & (F.col("evidence") > 0) & (F.col("links") > 0))


def join_identity(transactions: DataFrame, identity: DataFrame, on: str) -> DataFrame:
    return transactions.join(identity, on, "inner")


def attach_features(rows: DataFrame, features: DataFrame, on: str) -> DataFrame:
    """Features by id; rows without features keep NULL."""
    return rows.join(features, on, "left")
