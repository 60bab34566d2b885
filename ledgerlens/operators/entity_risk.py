"""Share of fraud among the labels of an entity that had arrived in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import CLOCK_ANCHOR_S, DAY_S, label_boundary
from ledgerlens.operators.running import prior_totals, steps_of, time_slot
from ledgerlens.operators.spread import spread_join

ENTITY = ["entity_key", "entity_type"]
MIN_OBSERVATIONS = 1


def entity_risk_asof(
    links: DataFrame,
    labels: DataFrame,
    queries: DataFrame,
    lag_days: int,
    anchor_s: int = CLOCK_ANCHOR_S,
) -> DataFrame:
    """Counts and fraud rate per query (entity, as_of) from labels that arrived by as_of − lag.

    ``labels``: transaction_id, value, arrival (second on the dataset clock). A label counts
    for queries from arrival + lag on; counts are running totals over labels and queries
    in one order, so no query is compared with each label.
    """
    known = labels.filter(F.col("value").isin(0, 1) & F.col("arrival").isNotNull()).select(
        "transaction_id", F.col("value").cast("int").alias("fraud"), "arrival"
    )
    linked = links.select("transaction_id", *ENTITY).distinct()
    # The last second at which the label is still unknown: totals are strictly earlier.
    unknown_until = F.col("arrival") + F.lit(lag_days * DAY_S - 1)
    arrivals = linked.join(known, "transaction_id", "inner").select(
        *ENTITY, unknown_until.alias("ts"), F.lit(1).alias("n"), F.col("fraud"), F.lit(0).alias("asked")
    )
    asked = queries.select(
        *ENTITY, F.col("as_of").alias("ts"), F.lit(0).alias("n"), F.lit(0).alias("fraud"), F.lit(1).alias("asked")
    )
    events = arrivals.unionByName(asked).withColumn("slot", time_slot(F.col("ts")))
    order = ["slot", "ts"]
    steps = steps_of(events, ENTITY, order, {c: F.sum(c) for c in ("n", "fraud", "asked")})
    totals = prior_totals(steps, ENTITY, order, sums=("n", "fraud")).filter("asked > 0")
    present = links.select(*ENTITY).distinct().withColumn("linked", F.lit(True))
    count, fraud = F.col("prior_n").cast("long"), F.col("prior_fraud").cast("long")
    return spread_join(totals, present, ENTITY, "left", by=["ts"]).select(
        *ENTITY,
        F.col("ts").alias("as_of"),
        label_boundary(F.col("ts"), lag_days, anchor_s).alias("eligible_boundary"),
        fraud.alias("fraud_count"),
        count.alias("label_count"),
        F.when(count >= MIN_OBSERVATIONS, F.try_divide(fraud, count)).alias("fraud_rate"),
        F.when(F.col("linked").isNull(), "no linked transactions").otherwise("").alias("note"),
    )
