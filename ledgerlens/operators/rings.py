"""Do features of shared entities help to find transactions of known rings?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import log_amount
from ledgerlens.operators import metrics as X
from ledgerlens.operators import modeling as M
from ledgerlens.operators.history import SHORT_WINDOWS, cumulative_history, cumulative_partners
from ledgerlens.operators.spread import spread_join
from ledgerlens.session import cut_lineage

# The trees of the comparison.
TREES = {"max_iter": 400, "max_depth": 6, "step_size": 0.08, "subsampling_rate": 0.85}


@dataclass(frozen=True)
class EntityRoles:
    """Input columns with any list of entities and pairs of them, for the history operators.

    ``entities``: role → column; ``pairs``: role → the two roles whose partners are counted.
    """

    entities: Mapping[str, str]
    pairs: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    row_id: str = "transaction_id"
    ts: str = "ts"
    amount: str = "amount"

    def roles(self) -> dict[str, tuple[str, str | None]]:
        both = {role: (self.entities[a], self.entities[b]) for role, (a, b) in self.pairs.items()}
        return {**{role: (column, None) for role, column in self.entities.items()}, **both}


def label_rings(txn: DataFrame, rings: DataFrame, account: str) -> DataFrame:
    """``txn`` with ``is_ring``: 1 where the account belongs to any ring of ``rings`` (ring, node)."""
    members = rings.select(F.col("node").cast("string").alias("_node")).filter("_node IS NOT NULL").distinct()
    marked = txn.withColumn("_node", F.col(account).cast("string"))
    joined = spread_join(marked, members.withColumn("_member", F.lit(1)), ["_node"], "left")
    return joined.withColumn("is_ring", F.coalesce("_member", F.lit(0))).drop("_node", "_member")


def entity_columns(
    txn: DataFrame, roles: EntityRoles, names: Mapping[str, str], windows: Mapping[str, int] = SHORT_WINDOWS, ties: str = "strict"
) -> DataFrame:
    """Cumulative history of each role and partners of each pair, one row per transaction.

    ``names`` gives the column prefix of each role.
    """
    blocks = {role: (names[role], windows) for role in roles.entities}
    parts = [cumulative_history(txn, blocks, roles, ties)]
    if roles.pairs:
        pairs = {role: (names[a], names[b]) for role, (a, b) in roles.pairs.items()}
        parts.append(cumulative_partners(txn, pairs, roles, ties))
    return reduce(lambda a, b: a.join(b, roles.row_id, "inner"), parts)


def base_columns(
    split: DataFrame, counted: Sequence[str], numeric: Sequence[str] = ("hour", "dow"), amount: str = "amount",
    row_id: str = "transaction_id", keep: Sequence[str] = (),
) -> DataFrame:
    """Log amount, numbers, and for each column of ``counted`` how many train rows share its value (-1: none)."""
    fitted = M.fit_frequency(split.filter("split = 'train'"), counted)
    return M.lookup_frequency(split, fitted, counted, value="n", row_id=row_id).select(
        row_id,
        *keep,
        log_amount(F.col(amount)).alias("log_amount"),
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[f"freq_{c}" for c in counted],
    )


def compare_models(
    matrix: DataFrame,
    variants: Mapping[str, Sequence[str]],
    label: str = "is_ring",
    row_id: str = "transaction_id",
    trees: Mapping[str, float] = TREES,
) -> DataFrame:
    """One row per variant (name → input columns): the threshold and all metrics of the test rows.

    ``matrix`` holds ``split``, the label and all inputs. Trees learn from the train rows, the
    valid rows end the training and give the threshold with the best F1.
    """
    scored = []
    for name, inputs in variants.items():
        filled, used = M.fill_missing(matrix.select(row_id, "split", label, *inputs), inputs)
        filled = cut_lineage(filled)
        model = M.train_classifier(filled, used, label=label, **trees)
        scored.append(M.score_rows(model, filled, name, row_id).drop("risk_band"))
    scores = cut_lineage(reduce(DataFrame.unionByName, scored))
    rows = scores.join(matrix.select(F.col(row_id).alias("transaction_id"), "split", label), "transaction_id")
    by = ["model_version"]
    thresholds = X.best_f1_threshold(rows.filter("split = 'valid'"), label, "risk_score", by)
    tested = rows.filter("split = 'test'")
    return X.full_metrics(tested, label, "risk_score", "transaction_id", by, thresholds)
