"""Queries over history features, profiles, splits and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.functions.keys import clean_device, clean_key
from ledgerlens.operators import history as H
from ledgerlens.operators import modeling as M
from ledgerlens.operators import profile as P
from ledgerlens.operators import review as R
from ledgerlens.plans.registry import query, r6
from ledgerlens.plans.tables import EVENTS_ANCHOR_S, table, transactions

_TAU = "(2 * pi() / 24)"


def _hour(at: str = "ts") -> str:
    return f"(({at} % 86400) // 3600)"


def _history_sql(frame: str, z_min: int, source: str = "txn") -> str:
    """All 16 features with plain windows; ``frame`` is the order and frame of the stateful ones."""
    strict = "ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    theta = f"({_hour()} * {_TAU})"

    def entity(key: str, z: str, hour: str, last: str, one: str, day: str, p: str) -> str:
        own = f"PARTITION BY {key}"
        return f"""
      count(amount) OVER ({own} {frame}) AS {p}n,
      avg(amount) OVER ({own} {frame}) AS {p}mean,
      stddev_pop(amount) OVER ({own} {frame}) AS {p}sd,
      avg(cos({theta})) OVER ({own} {frame}) AS {p}x,
      avg(sin({theta})) OVER ({own} {frame}) AS {p}y,
      max(ts) OVER ({own} {frame}) AS {p}last,
      count(*) OVER ({own} ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS {p}1h,
      count(*) OVER ({own} ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS {p}24h"""

    def outputs(key: str, z: str, hour: str, last: str, one: str, day: str, p: str) -> str:
        turn = f"(abs({theta} - atan2({p}y, {p}x)) % (2 * pi()))"
        return f"""
  CASE WHEN {key} IS NOT NULL AND {p}n >= {z_min}
       THEN round((amount - {p}mean) / greatest({p}sd, 1e-3) + 1e-9, 6) END AS {z},
  CASE WHEN {key} IS NOT NULL AND sqrt({p}x * {p}x + {p}y * {p}y) >= 1e-9
       THEN round(least({turn}, 2 * pi() - {turn}) / pi() + 1e-9, 6) END AS {hour},
  CASE WHEN {key} IS NOT NULL THEN round((ts - {p}last) / 3600.0::DOUBLE + 1e-9, 6) END AS {last},
  CASE WHEN {key} IS NOT NULL THEN {p}1h::DOUBLE END AS {one},
  CASE WHEN {key} IS NOT NULL THEN {p}24h::DOUBLE END AS {day}"""

    card = ("card_key", "amt_z_card", "hour_dev_card", "hours_since_last_card", "card_tx_1h", "card_tx_24h", "c_")
    device = (
        "device_key", "amt_z_device", "hour_dev_device", "hours_since_last_device", "dev_tx_1h", "dev_tx_24h", "d_",
    )
    return f"""WITH {{TXN}}, w AS (SELECT *, {entity(*card)}, {entity(*device)},
      count(*) OVER (PARTITION BY device_key, card_key {strict}) AS dc,
      count(*) OVER (PARTITION BY addr_key, card_key {strict}) AS ac,
      count(card_key) OVER (PARTITION BY device_key {frame}) AS dj,
      count(device_key) OVER (PARTITION BY card_key {frame}) AS cj,
      count(card_key) OVER (PARTITION BY addr_key {frame}) AS aj,
      count(DISTINCT card_key) OVER (PARTITION BY device_key ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS dd,
      count(DISTINCT device_key) OVER (PARTITION BY card_key ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS cd,
      count(DISTINCT card_key) OVER (PARTITION BY addr_key ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS ad
    FROM {source})
SELECT transaction_id, {outputs(*card)}, {outputs(*device)},
  CASE WHEN device_key IS NOT NULL THEN (dc = 0)::INT::DOUBLE END AS is_new_device_card_pair,
  CASE WHEN addr_key IS NOT NULL THEN (ac = 0)::INT::DOUBLE END AS is_new_addr_card_pair,
  CASE WHEN device_key IS NOT NULL THEN round(ln(1 + dc) + 1e-9, 6) END AS log_pair_count_device_card,
  CASE WHEN device_key IS NOT NULL AND dj > 0 THEN dd::DOUBLE END AS device_distinct_cards_24h,
  CASE WHEN device_key IS NOT NULL AND cj > 0 THEN cd::DOUBLE END AS card_distinct_devices_24h,
  CASE WHEN addr_key IS NOT NULL AND aj > 0 THEN ad::DOUBLE END AS addr_distinct_cards_7d
FROM w"""


_WHOLE = {
    "card_tx_1h", "card_tx_24h", "dev_tx_1h", "dev_tx_24h", "is_new_device_card_pair", "is_new_addr_card_pair",
    "device_distinct_cards_24h", "card_distinct_devices_24h", "addr_distinct_cards_7d",
}


def _shown(df):
    return df.select(
        *[F.col(c) if c in _WHOLE or c == "transaction_id" else r6(F.col(c)).alias(c) for c in df.columns]
    )


_STRICT = "ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_ROWS = "ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("relational_features", _history_sql(_STRICT, 2))
def relational_features(spark, folder):
    return _shown(H.relational_features(transactions(spark, folder)))


@query(
    "relational_features_row_order",
    _history_sql(_ROWS, 2, "(SELECT * REPLACE (ts // 3600 * 3600 AS ts) FROM txn)"),
)
def relational_features_row_order(spark, folder):
    hourly = transactions(spark, folder).withColumn("ts", F.floor(F.col("ts") / 3600) * 3600)
    return _shown(H.relational_features(hourly, ties="row_order"))


def _cumulative_sql(key: str, prefix: str, windows: dict[str, int], source: str) -> str:
    counts = ", ".join(
        f"CASE WHEN {key} IS NOT NULL THEN count(*) OVER (PARTITION BY {key} ORDER BY ts RANGE BETWEEN "
        f"{seconds} PRECEDING AND 1 PRECEDING)::DOUBLE END AS {prefix}_tx_prior_{name}"
        for name, seconds in windows.items()
    )
    w = f"OVER (PARTITION BY {key} {_STRICT})"
    return f"""SELECT transaction_id,
  CASE WHEN {key} IS NOT NULL THEN count(*) {w} END::DOUBLE AS {prefix}_tx_prior, {counts},
  CASE WHEN {key} IS NOT NULL THEN round((ts - max(ts) {w}) / 3600.0::DOUBLE + 1e-9, 6) END AS {prefix}_hours_since_last,
  CASE WHEN {key} IS NOT NULL THEN round(avg(amount) {w} + 1e-9, 6) END AS {prefix}_amt_prior_mean
FROM {source}"""


def _partners_sql(a: str, b: str, names: tuple[str, str], source: str) -> str:
    first, second = names
    return f"""SELECT transaction_id,
  CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN count(DISTINCT CASE WHEN {a} IS NOT NULL THEN {b} END)
    OVER (PARTITION BY {a} {_STRICT})::DOUBLE END AS {first}_distinct_{second}_prior,
  CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN count(DISTINCT CASE WHEN {b} IS NOT NULL THEN {a} END)
    OVER (PARTITION BY {b} {_STRICT})::DOUBLE END AS {second}_distinct_{first}_prior
FROM {source}"""


def _shown_all(df):
    return df.select("transaction_id", *[r6(F.col(c)).alias(c) for c in df.columns if c != "transaction_id"])


def _r6_all(sql: str) -> str:
    return f"SELECT transaction_id, round(COLUMNS(* EXCLUDE (transaction_id)) + 1e-9, 6) FROM ({sql})"


@query("cumulative_history", "WITH {TXN} " + _cumulative_sql("card_key", "card", H.LONG_WINDOWS, "txn"))
def cumulative_history(spark, folder):
    out = H.cumulative_history(transactions(spark, folder), {H.CARD: ("card", H.LONG_WINDOWS)})
    whole = {c: F.col(c).cast("double").alias(c) for c in out.columns if "_tx_" in c}
    return out.select(
        "transaction_id",
        *[whole.get(c, r6(F.col(c)).alias(c)) for c in out.columns if c != "transaction_id"],
    )


@query(
    "cumulative_partners",
    "WITH {TXN} " + _partners_sql("device_key", "card_key", ("dev", "card"), "txn"),
)
def cumulative_partners(spark, folder):
    out = H.cumulative_partners(transactions(spark, folder), {H.DEVICE_CARD: ("dev", "card")})
    return out.select("transaction_id", *[F.col(c).cast("double").alias(c) for c in out.columns[1:]])


_ENRICHED = "(SELECT * FROM txn WHERE device_key IS NOT NULL)"


@query(
    "history_block",
    f"""WITH {{TXN}},
 c AS ({_cumulative_sql("card_key", "card", H.LONG_WINDOWS, "txn")}),
 a AS ({_cumulative_sql("addr_key", "addr", H.SHORT_WINDOWS, "txn")}),
 d AS ({_cumulative_sql("device_key", "dev", H.SHORT_WINDOWS, _ENRICHED)}),
 p1 AS ({_partners_sql("device_key", "card_key", ("dev", "card"), _ENRICHED)}),
 p2 AS ({_partners_sql("device_key", "addr_key", ("dev", "addr"), _ENRICHED)}),
 p3 AS ({_partners_sql("addr_key", "card_key", ("addr", "card"), _ENRICHED)}),
 f AS (SELECT transaction_id, 1 AS has_device, (addr_key IS NOT NULL)::INT AS has_addr FROM {_ENRICHED})
SELECT transaction_id, COLUMNS(* EXCLUDE (transaction_id))::DOUBLE
FROM f JOIN c USING (transaction_id) JOIN a USING (transaction_id) JOIN d USING (transaction_id)
 JOIN p1 USING (transaction_id) JOIN p2 USING (transaction_id) JOIN p3 USING (transaction_id)""",
)
def history_block(spark, folder):
    txn = transactions(spark, folder)
    out = H.history_block(txn, txn.filter(F.col("device_key").isNotNull()))
    rounded = {c for c in out.columns if c.endswith(("_last", "_mean"))}
    return out.select(
        "transaction_id",
        *[
            (r6(F.col(c)) if c in rounded else F.col(c).cast("double")).alias(c)
            for c in out.columns
            if c != "transaction_id"
        ],
    )


_THETA = f"({_hour()} * {_TAU})"


def _dev_columns(key: str, z: str, hour: str) -> str:
    w = f"OVER (PARTITION BY {key} {_STRICT})"
    return f"""avg(amount) {w} AS m, stddev_pop(amount) {w} AS s, count(*) {w} AS n,
      avg(cos({_THETA})) {w} AS x, avg(sin({_THETA})) {w} AS y"""


def _dev_out(z: str, hour: str) -> str:
    turn = f"(abs({_THETA} - atan2(y, x)) % (2 * pi()))"
    return f"""CASE WHEN n > 0 THEN round((amount - m) / greatest(s, 1e-3) + 1e-9, 6) END AS {z},
      CASE WHEN sqrt(x * x + y * y) >= 1e-9 THEN round(least({turn}, 2 * pi() - {turn}) / pi() + 1e-9, 6) END AS {hour}"""


@query(
    "deviation_block",
    f"""WITH {{TXN}},
 c0 AS (SELECT *, {_dev_columns("card_key", "", "")},
   count(*) OVER (PARTITION BY card_key ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS v FROM txn),
 c AS (SELECT transaction_id, {_dev_out("card_amt_z", "card_hour_dev")},
   CASE WHEN n > 0 THEN round(v / sqrt(n) + 1e-9, 6) END AS card_burst_24h FROM c0),
 d0 AS (SELECT *, {_dev_columns("device_key", "", "")},
   count(*) OVER (PARTITION BY device_key, card_key {_STRICT}) AS dc,
   count(*) OVER (PARTITION BY addr_key, card_key {_STRICT}) AS ac FROM {_ENRICHED}),
 d AS (SELECT transaction_id, {_dev_out("dev_amt_z", "dev_hour_dev")},
   round(ln(1 + dc) + 1e-9, 6) AS pair_new_dev_card,
   CASE WHEN addr_key IS NOT NULL THEN round(ln(1 + ac) + 1e-9, 6) END AS pair_new_addr_card FROM d0)
SELECT * FROM d JOIN c USING (transaction_id)""",
)
def deviation_block(spark, folder):
    txn = transactions(spark, folder)
    return _shown_all(H.deviation_block(txn, txn.filter(F.col("device_key").isNotNull())))


# -- scalar expressions ---------------------------------------------------------


@query(
    "clean_key",
    """SELECT event_id, CAST(user_id AS VARCHAR) AS card_key, nullif(event_type, 'none') AS type_key,
       CASE WHEN event_id % 5 <> 0 THEN CAST(user_id // 2 AS VARCHAR) END AS addr_key FROM events""",
)
def clean_keys(spark, folder):
    events = table(spark, folder, "events")
    padded = F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))
    number = F.floor(F.col("user_id") / 2).cast("double").cast("string")
    address = F.when(F.col("event_id") % 5 == 0, F.lit(" NaN")).otherwise(number)
    return events.select(
        "event_id",
        clean_key(F.col("user_id")).alias("card_key"),
        clean_key(padded).alias("type_key"),
        clean_key(address).alias("addr_key"),
    )


@query(
    "clean_device",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 'phone ' || regexp_extract(props, '"k": *([0-9]+)', 1) END
       AS device FROM events""",
)
def clean_devices(spark, folder):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit(" Unknown ")).otherwise(
        F.concat(F.lit(" Phone "), F.get_json_object("props", "$.k"))
    )
    return table(spark, folder, "events").select("event_id", clean_device(raw).alias("device"))


@query(
    "scalar_columns",
    """WITH {TXN} SELECT transaction_id, (ts % 86400) // 3600 AS hour, (ts // 86400) % 7 AS dow,
  CASE WHEN risk_score >= 0.85 THEN 'CRITICAL' WHEN risk_score >= 0.6 THEN 'HIGH'
       WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  greatest(0, least(1, amount / 100 - 0.1)) AS clamped,
  round(ln(1 + amount) + 1e-9, 6) AS log_amount,
  CASE WHEN is_fraud = 1 THEN 1.0::DOUBLE WHEN device_key IS NOT NULL THEN 0.0::DOUBLE END AS flag,
  1704067200 + ts - 7 * 86400 AS boundary_s,
  ts + 86400 <= 20 * 86400 - 7 * 86400 AS eligible
FROM txn""",
)
def scalar_columns(spark, folder):
    flag = F.when(F.col("is_fraud") == 1, "T").when(F.col("device_key").isNotNull(), "F")
    boundary = S.label_boundary(F.col("ts"), 7, EVENTS_ANCHOR_S)
    return transactions(spark, folder).select(
        "transaction_id",
        S.hour_of(F.col("ts")).alias("hour"),
        S.dow_of(F.col("ts")).alias("dow"),
        S.risk_band(F.col("risk_score")).alias("band"),
        S.clamp_score(F.col("amount") / 100 - 0.1).alias("clamped"),
        r6(S.log_amount(F.col("amount"))).alias("log_amount"),
        S.flag_tf(flag).alias("flag"),
        (S.utc_to_clock(boundary, 0)).alias("boundary_s"),
        S.label_is_eligible(F.col("ts") + S.DAY_S, F.lit(20 * S.DAY_S), 7).alias("eligible"),
    )


# -- profiles -------------------------------------------------------------------


@query(
    "profile_columns",
    "WITH {TXN}, t AS (SELECT transaction_id, amount, card_key, device_key, addr_key FROM txn) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing,"
        f" round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS missing_pct,"
        f" {'count(DISTINCT ' + c + ')' if c.endswith('key') else 'NULL::BIGINT'} AS distinct_values FROM t"
        for c in ("transaction_id", "amount", "card_key", "device_key", "addr_key")
    ),
)
def profile_columns(spark, folder):
    txn = transactions(spark, folder).select("transaction_id", "amount", "card_key", "device_key", "addr_key")
    return P.profile_columns(txn, ("card_key", "device_key", "addr_key"))


@query(
    "profile_labels",
    """WITH {TXN} SELECT count(*) AS rows, count(*) - count(DISTINCT transaction_id) AS duplicate_ids,
  sum(is_fraud)::BIGINT AS positives, round(avg(is_fraud) * 100, 4) AS positive_pct, min(ts) AS ts_min,
  max(ts) AS ts_max, round((max(ts) - min(ts)) / 86400.0::DOUBLE, 2) AS span_days FROM txn""",
)
def profile_labels(spark, folder):
    return P.profile_labels(transactions(spark, folder), "transaction_id", "ts", "is_fraud")


@query(
    "daily_profile",
    """WITH {TXN} SELECT ts // 86400 AS day, count(*) AS rows, sum(is_fraud)::BIGINT AS positives,
  round(avg(is_fraud) + 1e-9, 6) AS rate, (ts // 86400) % 7 AS dow FROM txn GROUP BY ALL""",
)
def daily_profile(spark, folder):
    return P.daily_profile(transactions(spark, folder), "ts", "is_fraud").withColumn("rate", r6(F.col("rate")))


@query(
    "hourly_profile",
    """WITH {TXN} SELECT (ts % 86400) // 3600 AS hour, count(*) AS rows, sum(is_fraud)::BIGINT AS positives,
  round(avg(is_fraud) + 1e-9, 6) AS rate FROM txn GROUP BY ALL""",
)
def hourly_profile(spark, folder):
    return P.hourly_profile(transactions(spark, folder), "ts", "is_fraud").withColumn("rate", r6(F.col("rate")))


@query(
    "hourly_extremes",
    """WITH {TXN}, h AS (SELECT (ts % 86400) // 3600 AS hour, sum(is_fraud) / count(*) AS rate FROM txn GROUP BY 1)
SELECT round((SELECT min(rate) FROM h) + 1e-9, 6) AS min_rate,
  (SELECT hour FROM h ORDER BY rate, hour LIMIT 1) AS min_hour,
  round((SELECT max(rate) FROM h) + 1e-9, 6) AS max_rate,
  (SELECT hour FROM h ORDER BY rate DESC, hour LIMIT 1) AS max_hour""",
)
def hourly_extremes(spark, folder):
    out = P.hourly_extremes(transactions(spark, folder), "ts", "is_fraud")
    return out.select(r6(F.col("min_rate")).alias("min_rate"), "min_hour", r6(F.col("max_rate")).alias("max_rate"), "max_hour")


@query(
    "quantile_boundaries",
    """WITH {TXN} SELECT 0.7::DOUBLE AS fraction, round(quantile_cont(ts, 0.7) + 1e-9, 6) AS quantile FROM txn
UNION ALL SELECT 0.85, round(quantile_cont(ts, 0.85) + 1e-9, 6) FROM txn""",
)
def quantile_boundaries(spark, folder):
    return M.quantile_boundaries(transactions(spark, folder), "ts").withColumn("quantile", r6(F.col("quantile")))


def split_transactions(spark, folder):
    txn = transactions(spark, folder)
    return M.chronological_split(txn, "ts", *M.fit_boundaries(txn, "ts"))


_SPLIT = """b AS (SELECT quantile_cont(ts, 0.7) AS t1, quantile_cont(ts, 0.85) AS t2 FROM txn),
s AS (SELECT txn.*, CASE WHEN ts < t1 THEN 'train' WHEN ts < t2 THEN 'valid' ELSE 'test' END AS split FROM txn, b)"""


@query("chronological_split", f"WITH {{TXN}}, {_SPLIT} SELECT transaction_id, split FROM s")
def chronological_split(spark, folder):
    return split_transactions(spark, folder).select("transaction_id", "split")


@query(
    "split_summary",
    f"""WITH {{TXN}}, {_SPLIT} SELECT split, count(*) AS rows, sum(is_fraud)::BIGINT AS positives,
  round(avg(is_fraud) * 100, 3) AS positive_pct, min(ts) AS ts_min, max(ts) AS ts_max FROM s GROUP BY 1""",
)
def split_summary(spark, folder):
    return M.split_summary(split_transactions(spark, folder), "ts", "is_fraud")


@query(
    "split_overlap",
    f"""WITH {{TXN}}, {_SPLIT} SELECT max(ts) FILTER (split = 'train') >= min(ts) FILTER (split = 'valid') AS train_valid_overlap,
  max(ts) FILTER (split = 'valid') >= min(ts) FILTER (split = 'test') AS valid_test_overlap FROM s""",
)
def split_overlap(spark, folder):
    return M.split_overlap(split_transactions(spark, folder), "ts")


# -- encodings ------------------------------------------------------------------

_FREQ = """f AS (SELECT device_key AS category, count(*) AS n FROM s WHERE split = 'train' AND device_key IS NOT NULL GROUP BY 1),
g AS (SELECT addr_key AS category, count(*) AS n FROM s WHERE split = 'train' AND addr_key IS NOT NULL GROUP BY 1)"""


@query(
    "fit_frequency",
    f"""WITH {{TXN}}, {_SPLIT}, {_FREQ}
SELECT 'device_key' AS column_name, category, n, round(n / (SELECT sum(n) FROM f) + 1e-9, 6) AS share FROM f
UNION ALL SELECT 'addr_key', category, n, round(n / (SELECT sum(n) FROM g) + 1e-9, 6) FROM g""",
)
def fit_frequency(spark, folder):
    split = split_transactions(spark, folder)
    fitted = M.fit_frequency(split.filter("split = 'train'"), ("device_key", "addr_key"))
    return fitted.withColumn("share", r6(F.col("share")))


@query(
    "lookup_frequency",
    f"""WITH {{TXN}}, {_SPLIT}, {_FREQ} SELECT transaction_id,
  round(coalesce(f.n / (SELECT sum(n) FROM f), -1) + 1e-9, 6) AS freq_device_key
FROM s LEFT JOIN f ON f.category = s.device_key""",
)
def lookup_frequency(spark, folder):
    split = split_transactions(spark, folder)
    fitted = M.fit_frequency(split.filter("split = 'train'"), ("device_key",))
    out = M.lookup_frequency(split, fitted, ("device_key",))
    return out.select("transaction_id", r6(F.col("freq_device_key")).alias("freq_device_key"))


@query(
    "fit_counts",
    f"""WITH {{TXN}}, {_SPLIT}, {_FREQ} SELECT transaction_id, coalesce(g.n, -1)::DOUBLE AS count_addr_key
FROM s LEFT JOIN g ON g.category = s.addr_key""",
)
def fit_counts(spark, folder):
    split = split_transactions(spark, folder)
    fitted = M.fit_frequency(split.filter("split = 'train'"), ("addr_key",))
    out = M.lookup_frequency(split, fitted, ("addr_key",), value="n", prefix="count_")
    return out.select("transaction_id", "count_addr_key")


_FEATURES = _history_sql(_STRICT, 2).replace("WITH {TXN}, w AS", "w AS")
_MATRIX_HEAD, _MATRIX_TAIL = _FEATURES.split("\nSELECT transaction_id,", 1)


def model_rows(spark, folder):
    """Transactions with split, clock parts and a T/F flag."""
    return split_transactions(spark, folder).select(
        "*",
        S.hour_of(F.col("ts")).alias("hour"),
        S.dow_of(F.col("ts")).alias("dow"),
        F.when(F.col("addr_key").isNull(), None).when(F.col("transaction_id") % 2 == 0, "T").otherwise("F").alias("M1"),
    )


def model_matrix(spark, folder, relational=True):
    rows = model_rows(spark, folder)
    fitted = M.fit_frequency(rows.filter("split = 'train'"), ("device_key", "card_key"))
    features = H.relational_features(transactions(spark, folder)) if relational else None
    return M.feature_matrix(
        rows, fitted, features, categories=("device_key", "card_key"), flags=("M1",), keep=("split", "is_fraud")
    )


_BASE_SQL = """round(ln(1 + amount) + 1e-9, 6) AS log_amount, ((ts % 86400) // 3600)::DOUBLE AS hour,
  ((ts // 86400) % 7)::DOUBLE AS dow,
  round(coalesce(f.n / (SELECT sum(n) FROM f), -1) + 1e-9, 6) AS freq_device_key,
  round(coalesce(k.n / (SELECT sum(n) FROM k), -1) + 1e-9, 6) AS freq_card_key,
  CASE WHEN addr_key IS NOT NULL THEN (transaction_id % 2 = 0)::INT::DOUBLE END AS "M1" """
_CARD_FREQ = "k AS (SELECT card_key AS category, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1)"


@query(
    "feature_matrix",
    f"""WITH {{TXN}}, {_SPLIT}, {_FREQ}, {_CARD_FREQ}, {_MATRIX_HEAD}, r AS (SELECT transaction_id,{_MATRIX_TAIL})
SELECT transaction_id, split, is_fraud, {_BASE_SQL}, amt_z_card, amt_z_device, hour_dev_card, hour_dev_device,
  hours_since_last_card, hours_since_last_device
FROM s LEFT JOIN f ON f.category = s.device_key LEFT JOIN k ON k.category = s.card_key
JOIN r USING (transaction_id)""",
)
def feature_matrix(spark, folder):
    out = model_matrix(spark, folder)
    plain = {"transaction_id", "split", "is_fraud", "hour", "dow", "M1"}
    return out.select(*[F.col(c) if c in plain else r6(F.col(c)).alias(c) for c in out.columns])


@query(
    "base_matrix",
    f"""WITH {{TXN}}, {_SPLIT}, {_FREQ}, {_CARD_FREQ} SELECT transaction_id, split, is_fraud, {_BASE_SQL}
FROM s LEFT JOIN f ON f.category = s.device_key LEFT JOIN k ON k.category = s.card_key""",
)
def base_matrix(spark, folder):
    out = model_matrix(spark, folder, relational=False)
    plain = {"transaction_id", "split", "is_fraud", "hour", "dow", "M1"}
    return out.select(*[F.col(c) if c in plain else r6(F.col(c)).alias(c) for c in out.columns])


@query(
    "leakage_audit",
    "SELECT (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16') AS rows_compared, 0::BIGINT AS rows_changed",
)
def leakage_audit(spark, folder):
    """Exact counts only: sums may differ in the last digit when the partitions differ."""
    def counts(df):
        out = H.relational_features(df)
        return out.select("transaction_id", *[(r6(F.col(c))).alias(c) for c in out.columns[1:]])

    txn = transactions(spark, folder)
    return M.leakage_audit(counts, txn, "ts", 15 * S.DAY_S - 1, "transaction_id")


# -- joins ----------------------------------------------------------------------


@query(
    "join_identity",
    """SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey, o_totalprice FROM orders
JOIN customer ON o_custkey = c_custkey""",
)
def join_identity(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = R.join_identity(orders, table(spark, folder, "customer"), "c_custkey")
    return joined.select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey", "o_totalprice")


@query(
    "attach_features",
    """SELECT c_custkey, n_orders, round(total + 1e-9, 6) AS total FROM customer LEFT JOIN
 (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def attach_features(spark, folder):
    features = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    )
    out = R.attach_features(table(spark, folder, "customer").select("c_custkey"), features, "c_custkey")
    return out.withColumn("total", r6(F.col("total")))
