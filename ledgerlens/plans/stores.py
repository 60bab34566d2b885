"""Queries over stored sketches, bucketed stores and imports with rejects."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ledgerlens.functions.scalars import day_of
from ledgerlens.operators import profile as P
from ledgerlens.operators import sketches as K
from ledgerlens.plans.registry import query
from ledgerlens.plans.review import _work
from ledgerlens.plans.tables import table, transactions
from ledgerlens.sources import stores as S

BUCKETS = 64
PROFILED = ("transaction_id", "amount", "card_key", "device_key", "addr_key")
SPLITS = (0.7, 0.85)


def _by_day(spark, folder, name, made):
    """Chunks of days written in two runs, the second of the newer half only."""
    txn = transactions(spark, folder)
    day, place = day_of(F.col("ts")), _work(spark, name)
    for part in (day < 45, day >= 45):
        made(txn.filter(part), day).write.mode("append").parquet(place)
    return txn, spark.read.parquet(place)


@query(
    "merged_quantiles",
    """WITH {TXN} SELECT unnest([0.7::DOUBLE, 0.85::DOUBLE]) AS fraction, count(*) AS rows, true AS near FROM txn""",
)
def merged_quantiles(spark, folder):
    """Split boundaries from daily sketches; ``near`` if the rank of the boundary is within 1 % of its fraction."""
    txn, stored = _by_day(spark, folder, "quantiles", lambda df, day: K.quantile_sketches(df, "ts", day))
    found = K.merged_quantiles(stored, SPLITS)
    ranks = []
    for f in SPLITS:
        at = found.filter(F.col("fraction") == f).select("quantile").scalar()
        below = F.avg((F.col("ts") <= at).cast("double"))
        ranks.append(F.struct(F.lit(f).alias("fraction"), (F.abs(below - f) <= 0.01).alias("near")))
    ranked = txn.filter("ts IS NOT NULL").agg(F.array(*ranks).alias("_r")).select(F.inline("_r"))
    return found.select("fraction", "rows").join(ranked, "fraction")


@query(
    "merged_profile",
    "WITH {TXN} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing,"
        f" round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct,"
        + (
            f" NULL::DOUBLE AS min_number, NULL::DOUBLE AS max_number, min({c}) AS min_text, max({c}) AS max_text,"
            if c.endswith("key")
            else f" min({c})::DOUBLE AS min_number, max({c})::DOUBLE AS max_number, NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text,"
        )
        + " true AS near FROM txn"
        for c in PROFILED
    ),
)
def merged_profile(spark, folder):
    """The profile from daily partial profiles; ``near`` if the distinct count is within 2 % of the exact one."""
    txn, stored = _by_day(spark, folder, "profile", lambda df, day: K.partial_profile(df, PROFILED, day))
    exact = P.profile_columns(txn.select(*PROFILED), PROFILED).select("column_name", F.col("distinct_values").alias("_exact"))
    near = F.abs(F.col("distinct_values") - F.col("_exact")) <= F.col("_exact") * 0.02
    return K.merged_profile(stored).join(exact, "column_name").select(
        "column_name", "rows", "missing", "missing_pct", "min_number", "max_number", "min_text", "max_text", near.alias("near")
    )


def _balances(spark, folder):
    """Customers as a store (k, v, at) in buckets of k."""
    stored = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("long").alias("k"), F.col("c_acctbal").cast("double").alias("v"), F.lit(0).cast("long").alias("at")
    )
    place = _work(spark, "store")
    S.write_store(stored, place, ["k"], BUCKETS)
    return stored, place


@query(
    "upsert_store",
    """WITH m AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS new, 0 AS "at" FROM customer
  UNION ALL SELECT o_custkey, o_totalprice, 1, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
SELECT k, v, "at" FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY new DESC, "at" DESC) = 1""",
)
def upsert_store(spark, folder):
    """Open urgent orders upserted into the buckets they touch."""
    stored, place = _balances(spark, folder)
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    incoming = urgent.select(
        F.col("o_custkey").cast("long").alias("k"), F.col("o_totalprice").cast("double").alias("v"), F.col("o_orderkey").cast("long").alias("at")
    )
    S.upsert_into_store(incoming, place, ["k"], "at", BUCKETS)
    return S.read_store(spark, place, stored.schema)


@query(
    "append_store",
    """SELECT c_custkey AS k, c_acctbal AS v, 0::BIGINT AS "at" FROM customer UNION ALL
SELECT o_custkey + 10, arg_min(o_totalprice, o_totalprice * 1e9 + o_orderkey), arg_min(o_orderkey, o_totalprice * 1e9 + o_orderkey)
FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def append_store(spark, folder):
    """Orders of unknown customers appended, each customer once."""
    stored, place = _balances(spark, folder)
    incoming = table(spark, folder, "orders").select(
        (F.col("o_custkey") + 10).cast("long").alias("k"), F.col("o_totalprice").cast("double").alias("v"), F.col("o_orderkey").cast("long").alias("at")
    )
    S.append_into_store(incoming, place, "k", BUCKETS)
    return S.read_store(spark, place, stored.schema)


_ORDER = StructType(
    [
        StructField("o_orderkey", LongType()),
        StructField("o_custkey", LongType()),
        StructField("o_orderstatus", StringType()),
        StructField("o_totalprice", DoubleType()),
        StructField("o_orderpriority", StringType()),
    ]
)


@query(
    "csv_rejects",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderpriority,
  CASE WHEN o_orderstatus = 'P' THEN o_orderkey || ',' || o_custkey || ',P,open,' || o_orderpriority END AS rejected FROM orders""",
)
def csv_rejects(spark, folder):
    """Orders as CSV whose price is a word while they are open: those rows are rejected with their text."""
    price = F.when(F.col("o_orderstatus") == "P", "open").otherwise(F.col("o_totalprice").cast("string"))
    place = _work(spark, "csv")
    table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"), "o_orderpriority").write.csv(
        place, header=True
    )
    good, bad = S.read_csv_with_rejects(spark, place, _ORDER)
    rejected = bad.select("parsed.*", F.col(S.REJECTED).alias("rejected"))
    return good.withColumn("rejected", F.lit(None).cast("string")).unionByName(rejected)


@query(
    "read_ages",
    """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority,
  NULL::VARCHAR AS channel FROM orders""",
)
def read_ages(spark, folder):
    """Finished orders were stored before the priority was known; no file knows the channel."""
    orders, place = table(spark, folder, "orders"), _work(spark, "ages")
    orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").write.parquet(f"{place}/first")
    orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority", "o_totalprice").write.parquet(f"{place}/second")
    names = ("o_orderkey", "o_totalprice", "o_orderpriority")
    fields = [StructField(n, orders.schema[n].dataType) for n in names]
    return S.read_ages(spark, place, StructType([*fields, StructField("channel", StringType())]))
