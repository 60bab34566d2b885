"""History features to evidence to review queue in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.scalars import risk_band
from ledgerlens.operators.evidence import ev_amount_deviation
from ledgerlens.operators.review import risk_queue
from ledgerlens.plans.network import _AMOUNT, _ROWS, _featured
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import transactions


@query(
    "evidence_queue",
    f"""WITH {{TXN}}, {_ROWS}, {_AMOUNT} SELECT transaction_id, risk_score,
  CASE WHEN risk_score >= 0.85 THEN 'CRITICAL' WHEN risk_score >= 0.6 THEN 'HIGH'
       WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band, true AS has_evidence
FROM txn WHERE transaction_id IN (SELECT transaction_id FROM amount_ev) ORDER BY risk_score DESC, transaction_id LIMIT 25""",
)
def evidence_queue(spark, folder):
    rows = _featured(spark, folder)
    scores = transactions(spark, folder).select(
        "transaction_id", "risk_score", risk_band(F.col("risk_score")).alias("risk_band")
    )
    return risk_queue(scores, ev_amount_deviation(rows), 25, has_evidence=True)
