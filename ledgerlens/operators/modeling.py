"""Splits by time, encodings fitted on training rows, training and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import flag_tf, log_amount, risk_band
from ledgerlens.operators.profile import exact_quantiles
from ledgerlens.operators.running import prior_totals, time_slot
from ledgerlens.operators.spread import spread_join
from ledgerlens.sources.tables import replace_version

# The frozen relational inputs of the model, and split fractions.
MODEL_RELATIONAL = (
    "amt_z_card",
    "amt_z_device",
    "hour_dev_card",
    "hour_dev_device",
    "hours_since_last_card",
    "hours_since_last_device",
)
SPLIT_FRACTIONS = (0.70, 0.85)
UNSEEN = -1.0
SEED = 42


# -- splits -------------------------------------------------------------------


def quantile_boundaries(df: DataFrame, ts: str, fractions: Sequence[float] = SPLIT_FRACTIONS) -> DataFrame:
    """Exact time quantiles (fraction, quantile)."""
    return exact_quantiles(df, ts, fractions, levels=[time_slot(F.col(ts))])


def fit_boundaries(df: DataFrame, ts: str, fractions: Sequence[float] = SPLIT_FRACTIONS) -> tuple[float, float]:
    """The two boundaries as numbers."""
    first, second = sorted(r["quantile"] for r in quantile_boundaries(df, ts, fractions).collect())
    return first, second


def chronological_split(df: DataFrame, ts: str, train_end: float, valid_end: float) -> DataFrame:
    """``split``: train before ``train_end``, valid before ``valid_end``, test from there."""
    if not train_end < valid_end:
        raise ValueError("train_end must precede valid_end")
    at = F.col(ts)
    return df.withColumn(
        "split", F.when(at < train_end, "train").when(at < valid_end, "valid").when(at.isNotNull(), "test")
    )


def split_summary(split: DataFrame, ts: str, label: str) -> DataFrame:
    """Rows, label rate and time range per split."""
    return split.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum(label).alias("positives"),
        F.round(F.avg(label) * 100, 3).alias("positive_pct"),
        F.min(ts).alias("ts_min"),
        F.max(ts).alias("ts_max"),
    )


def split_overlap(split: DataFrame, ts: str) -> DataFrame:
    """One row: does any earlier split reach into a later one (must be false)."""
    def edge(name, fold):
        return fold(F.when(F.col("split") == name, F.col(ts)))

    return split.agg(
        F.coalesce(edge("train", F.max) >= edge("valid", F.min), F.lit(False)).alias("train_valid_overlap"),
        F.coalesce(edge("valid", F.max) >= edge("test", F.min), F.lit(False)).alias("valid_test_overlap"),
    )


# -- encodings ----------------------------------------------------------------


def fit_frequency(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, category, n, share) over the non-missing training values of each column."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in columns
    ]
    counts = (
        train.select(F.inline(F.array(*entries)))
        .filter(F.col("category").isNotNull())
        .groupBy("column_name", "category")
        .agg(F.count("*").alias("n"))
    )
    sizes = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    # One row per encoded column.
    return counts.join(F.broadcast(sizes), "column_name", "inner").select(
        "column_name", "category", "n", (F.col("n") / F.col("total")).alias("share")
    )


def lookup_frequency(
    df: DataFrame, fitted: DataFrame, columns: Sequence[str], value: str = "share", prefix: str = "freq_",
    row_id: str = "transaction_id",
) -> DataFrame:
    """Replace categories by their fitted value; unseen and missing become -1.

    ``row_id`` is unique. All columns go through one join on (column, category) and one
    fold by row, so the plan is the same for one column and for hundreds.
    """
    if not columns:
        return df
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in columns
    ]
    cells = df.select(row_id, F.inline(F.array(*entries))).filter(F.col("category").isNotNull())
    known = fitted.select("column_name", "category", F.col(value).cast("double").alias("_value"))
    found = spread_join(cells, known, ["column_name", "category"], "inner", by=[row_id])
    folded = found.groupBy(row_id).agg(
        *[F.max(F.when(F.col("column_name") == c, F.col("_value"))).alias(f"{prefix}{c}") for c in columns]
    )
    names = {f"{prefix}{c}": F.coalesce(F.col(f"{prefix}{c}"), F.lit(UNSEEN)) for c in columns}
    return df.join(folded, row_id, "left").withColumns(names).select(*df.columns, *names)


def feature_matrix(
    df: DataFrame,
    fitted: DataFrame,
    relational: DataFrame | None,
    amount: str = "amount",
    numeric: Sequence[str] = ("hour", "dow"),
    categories: Sequence[str] = (),
    flags: Sequence[str] = (),
    relational_columns: Sequence[str] = MODEL_RELATIONAL,
    row_id: str = "transaction_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Model inputs in a fixed order: log amount, numbers, frequencies, T/F flags, relational columns."""
    encoded = lookup_frequency(df, fitted, categories, row_id=row_id)
    if relational is not None:
        encoded = encoded.join(relational.select(row_id, *relational_columns), row_id, "left")
    columns = [log_amount(F.col(amount)).alias("log_amount")]
    columns += [F.col(c).cast("double").alias(c) for c in numeric]
    columns += [F.col(f"freq_{c}") for c in categories]
    columns += [flag_tf(F.col(c)).alias(c) for c in flags]
    if relational is not None:
        columns += [F.col(c) for c in relational_columns]
    return encoded.select(row_id, *keep, *columns)


def fill_missing(matrix: DataFrame, inputs: Sequence[str], sentinel: float = -999.0) -> tuple[DataFrame, list[str]]:
    """Missing inputs become a sentinel plus an indicator: trees here have no missing values."""
    filled = [F.coalesce(F.col(c), F.lit(sentinel)).alias(c) for c in inputs]
    marks = [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in inputs]
    others = [c for c in matrix.columns if c not in inputs]
    return matrix.select(*others, *filled, *marks), [*inputs, *[f"{c}_missing" for c in inputs]]


# -- model --------------------------------------------------------------------


def train_classifier(
    matrix: DataFrame,
    inputs: Sequence[str],
    label: str = "is_fraud",
    split: str = "split",
    max_iter: int = 600,
    max_depth: int = 7,
    step_size: float = 0.05,
    subsampling_rate: float = 0.8,
    seed: int = SEED,
    stop_on_loss: bool = True,
) -> PipelineModel:
    """Boosted trees on the train rows; the valid rows stop the training early, unless told not to."""
    used = matrix.filter(F.col(split).isin("train", "valid")).withColumn("_valid", F.col(split) == "valid")
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="_features")
    trees = GBTClassifier(
        featuresCol="_features",
        labelCol=label,
        maxIter=max_iter,
        maxDepth=max_depth,
        stepSize=step_size,
        subsamplingRate=subsampling_rate,
        seed=seed,
    )
    if stop_on_loss:
        trees.setValidationIndicatorCol("_valid")
    else:
        used = used.filter("NOT _valid")
    return Pipeline(stages=[assembler, trees]).fit(used)


def score_rows(model: PipelineModel, matrix: DataFrame, version: str, row_id: str = "transaction_id") -> DataFrame:
    """(transaction_id, model_version, risk_score, risk_band) of every row."""
    score = vector_to_array(F.col("probability"))[1]
    return model.transform(matrix).select(
        F.col(row_id).alias("transaction_id"), F.lit(version).alias("model_version"), score.alias("risk_score")
    ).withColumn("risk_band", risk_band(F.col("risk_score")))


def batch_score(model: PipelineModel, matrix: DataFrame, version: str, path: str) -> DataFrame:
    """Score every row, replace what is stored of this version at ``path``, and read it back."""
    replace_version(score_rows(model, matrix, version), path)
    stored = matrix.sparkSession.read.parquet(path)
    return stored.filter(F.col("model_version") == version)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_missing(model: PipelineModel, matrix: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """Score only the rows that have no stored score of this version."""
    have = stored.filter(F.col("model_version") == version).select("transaction_id")
    return score_rows(model, matrix.join(have, "transaction_id", "left_anti"), version)


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model_version").agg(
        F.count("*").alias("rows_scored"), F.round(F.avg("risk_score"), 4).alias("mean_score")
    )


def score_drift(first: DataFrame, second: DataFrame) -> DataFrame:
    """Largest and mean absolute difference of two scorings of the same rows."""
    gap = F.abs(F.col("a") - F.col("b"))
    return first.select("transaction_id", F.col("risk_score").alias("a")).join(
        second.select("transaction_id", F.col("risk_score").alias("b")), "transaction_id", "inner"
    ).agg(
        F.count("*").alias("rows"), F.max(gap).alias("max_abs_diff"), F.avg(gap).alias("mean_abs_diff")
    )


def importances(model: PipelineModel) -> dict[str, float]:
    """Share of each input in the trees' gains; the weights for ``top_contributions``."""
    trees: GBTClassificationModel = model.stages[-1]
    return dict(zip(model.stages[0].getInputCols(), (float(v) for v in trees.featureImportances.toArray())))


def top_contributions(
    matrix: DataFrame, weights: Mapping[str, float], k: int = 5, row_id: str = "transaction_id"
) -> DataFrame:
    """The k inputs with the largest weight · |value − mean of the row's values|, one row each."""
    names = list(weights)
    values = F.array(*[F.col(c).cast("double") for c in names])
    present = F.filter(values, lambda v: v.isNotNull())
    mean = F.try_divide(
        F.aggregate(present, F.lit(0.0), lambda a, v: a + v), F.size(present)
    )
    entries = F.array(
        *[
            F.struct(
                (F.lit(-float(weights[c])) * F.abs(F.col(c) - F.col("_mean"))).alias("sort"),
                F.lit(i).alias("position"),
                F.lit(c).alias("feature"),
                F.col(c).cast("double").alias("value"),
            )
            for i, c in enumerate(names)
        ]
    )
    filled = F.transform(
        entries,
        lambda e: F.struct(
            F.coalesce(e["sort"], F.lit(0.0)).alias("sort"),
            e["position"].alias("position"),
            e["feature"].alias("feature"),
            e["value"].alias("value"),
        ),
    )
    top = matrix.withColumn("_mean", mean).select(
        row_id, F.posexplode(F.slice(F.array_sort(filled), 1, k)).alias("pos", "e")
    )
    contribution = -F.col("e.sort")
    return top.select(
        row_id,
        (F.col("pos") + 1).alias("abs_rank"),
        F.col("e.feature").alias("feature"),
        F.col("e.value").alias("value"),
        contribution.alias("contribution"),
        F.when(contribution > 0, "positive").when(contribution < 0, "negative").otherwise("neutral").alias("direction"),
    )


# -- controls -----------------------------------------------------------------


def random_rank(df: DataFrame, by: Sequence[str], row_id: str, seed: int) -> DataFrame:
    """Position of each row in a random order within its group, as ``place`` from 0.

    The order is that of a hash of the id; ranges of the hash take the place of one
    global sort per group.
    """
    hashed = F.xxhash64(F.col(row_id), F.lit(seed))
    keyed = df.withColumn("_hash", hashed).select(
        *by,
        F.shiftright("_hash", 54).cast("long").alias("_part"),
        F.shiftright("_hash", 44).cast("long").alias("_piece"),
        "_hash",
        F.col(row_id).alias("_id"),
        F.lit(1).alias("n"),
    )
    ranked = prior_totals(keyed, by, ["_part", "_piece", "_hash", "_id"], sums=("n",))
    return ranked.select(*by, F.col("_id").alias(row_id), F.col("prior_n").cast("long").alias("place"))


def shuffle_features(
    df: DataFrame, features: Sequence[str], by: Sequence[str], row_id: str = "transaction_id", seed: int = SEED
) -> DataFrame:
    """Give each row the features of a random other row of its group, as a control for alignment."""
    by = list(by)
    mine = random_rank(df, by, row_id, seed)
    theirs = random_rank(df, by, row_id, seed + 1).withColumnRenamed(row_id, "_donor")
    swap = mine.join(theirs, [*by, "place"], "inner").select(row_id, "_donor")
    donor = df.select(F.col(row_id).alias("_donor"), *features)
    rest = df.drop(*features)
    return rest.join(swap, row_id, "inner").join(donor, "_donor", "inner").select(*df.columns)


def leakage_audit(compute, df: DataFrame, ts: str, cutoff: Column | float, row_id: str) -> DataFrame:
    """Rows up to the cutoff whose features change when the later rows are removed (must be none).

    ``compute`` is a function from rows to features with ``row_id``.
    """
    full = compute(df)
    short = compute(df.filter(F.col(ts) <= cutoff))
    names = [c for c in short.columns if c != row_id]
    both = short.alias("s").join(full.alias("f"), row_id, "inner")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in names]
    changed = F.lit(False)
    for equal in same:
        changed = changed | ~equal
    return both.agg(F.count("*").alias("rows_compared"), F.count_if(changed).alias("rows_changed"))
