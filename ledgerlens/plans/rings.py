"""Queries that judge features of shared entities on known rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.scalars import day_of, dow_of, hour_of
from ledgerlens.operators import modeling as M
from ledgerlens.operators import rings as R
from ledgerlens.operators.history import SHORT_WINDOWS
from ledgerlens.plans.features import _cumulative_sql, _partners_sql
from ledgerlens.plans.registry import query, r6
from ledgerlens.plans.tables import transactions

ROLES = R.EntityRoles({"DEVICE": "device_key", "INSTRUMENT": "addr_key"}, {"DEVICE_INSTRUMENT": ("DEVICE", "INSTRUMENT")})
NAMES = {"DEVICE": "dev", "INSTRUMENT": "inst"}
BASE = ["log_amount", "hour", "dow", "freq_device_key", "freq_merchant"]


def ring_rows(spark, folder):
    """Transactions with an account (card and day), an instrument and a merchant, labelled by ring and split by time."""
    txn = transactions(spark, folder)
    account = F.concat_ws("/", F.lpad(day_of(F.col("ts")).cast("string"), 3, "0"), F.lpad("card_key", 8, "0"))
    txn = txn.withColumns(
        {
            "account": account,
            "merchant": F.pmod(F.floor("amount"), F.lit(20)).cast("string"),
            "hour": hour_of(F.col("ts")),
            "dow": dow_of(F.col("ts")),
        }
    )
    rings = txn.filter("is_fraud = 1 AND device_key IS NOT NULL").select(
        F.concat(F.lit("ring"), F.pmod(day_of(F.col("ts")), F.lit(5)).cast("string")).alias("ring"), F.col("account").alias("node")
    )
    return M.chronological_split(R.label_rings(txn, rings, "account"), "ts", *M.fit_boundaries(txn, "ts"))


def ring_matrix(spark, folder):
    rows = ring_rows(spark, folder)
    base = R.base_columns(rows, ("device_key", "merchant"), keep=("split", "is_ring"))
    return base.join(R.entity_columns(rows, ROLES, NAMES), "transaction_id")


@query(
    "ring_inputs",
    f"""WITH {{TXN}},
acc AS (SELECT *, lpad((ts // 86400)::VARCHAR, 3, '0') || '/' || lpad(card_key, 8, '0') AS account,
  (floor(amount)::BIGINT % 20)::VARCHAR AS merchant FROM txn),
q AS (SELECT quantile_cont(ts::DOUBLE, 0.7) AS a, quantile_cont(ts::DOUBLE, 0.85) AS b FROM txn),
s AS (SELECT acc.*, CASE WHEN ts < a THEN 'train' WHEN ts < b THEN 'valid' ELSE 'test' END AS split,
  (account IN (SELECT account FROM acc WHERE is_fraud = 1 AND device_key IS NOT NULL))::INT AS is_ring FROM acc, q),
fd AS (SELECT device_key, count(*)::DOUBLE AS n FROM s WHERE split = 'train' GROUP BY 1),
fm AS (SELECT merchant, count(*)::DOUBLE AS n FROM s WHERE split = 'train' GROUP BY 1),
d AS ({_cumulative_sql("device_key", "dev", SHORT_WINDOWS, "txn")}),
i AS ({_cumulative_sql("addr_key", "inst", SHORT_WINDOWS, "txn")}),
p AS ({_partners_sql("device_key", "addr_key", ("dev", "inst"), "txn")})
SELECT transaction_id, split, is_ring, round(ln(1 + amount) + 1e-9, 6) AS log_amount, ((ts % 86400) // 3600)::DOUBLE AS hour,
  ((ts // 86400) % 7)::DOUBLE AS dow, coalesce(fd.n, -1)::DOUBLE AS freq_device_key, coalesce(fm.n, -1)::DOUBLE AS freq_merchant,
  d.* EXCLUDE (transaction_id), i.* EXCLUDE (transaction_id), p.* EXCLUDE (transaction_id)
FROM s LEFT JOIN fd ON fd.device_key = s.device_key LEFT JOIN fm ON fm.merchant = s.merchant
 JOIN d USING (transaction_id) JOIN i USING (transaction_id) JOIN p USING (transaction_id)""",
)
def ring_inputs(spark, folder):
    """What both models of ``ring_detection`` are given."""
    out = ring_matrix(spark, folder)
    rounded = {c for c in out.columns if c == "log_amount" or c.endswith(("_hours_since_last", "_amt_prior_mean"))}
    counts = [c for c in out.columns if "_prior" in c and c not in rounded]
    return out.select(*[r6(F.col(c)).alias(c) if c in rounded else F.col(c).cast("double").alias(c) if c in counts else F.col(c) for c in out.columns])


@query("ring_detection")
def ring_detection(spark, folder):
    """Threshold and test metrics of a model without and of one with cumulative entity and pair columns."""
    matrix = ring_matrix(spark, folder)
    shared = [c for c in matrix.columns if c not in ("transaction_id", "split", "is_ring", *BASE)]
    return R.compare_models(matrix, {"base": BASE, "graph": [*BASE, *shared]})
