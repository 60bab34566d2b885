"""Queries over scores, the review queue, metrics, cases, labels and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions.canonical import canonical_json, content_hash
from ledgerlens.functions.scalars import DAY_S, risk_band
from ledgerlens.operators import cases as K
from ledgerlens.operators import entity_risk as ER
from ledgerlens.operators import graph as G
from ledgerlens.operators import metrics as X
from ledgerlens.operators import modeling as M
from ledgerlens.operators import review as R
from ledgerlens.plans.features import model_matrix
from ledgerlens.plans.registry import query, r6
from ledgerlens.plans.tables import EVENTS_ANCHOR_S, table, transactions
from ledgerlens.session import cut_lineage, shared_dir
from ledgerlens.sources import tables as T

_BAND = """CASE WHEN risk_score >= 0.85 THEN 'CRITICAL' WHEN risk_score >= 0.6 THEN 'HIGH'
 WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"""
_SCORES = f"""scores AS (SELECT transaction_id, risk_score, {_BAND} AS risk_band, is_fraud, device_key FROM txn),
evidence AS (SELECT 'ev-' || transaction_id AS evidence_id, transaction_id FROM txn WHERE amount >= 80 OR device_key IS NULL)"""


def _scores(spark, folder):
    return transactions(spark, folder).select(
        "transaction_id", "risk_score", risk_band(F.col("risk_score")).alias("risk_band"), "is_fraud", "device_key"
    )


def _evidence(spark, folder):
    hit = (F.col("amount") >= 80) | F.col("device_key").isNull()
    return transactions(spark, folder).filter(hit).select(
        F.concat(F.lit("ev-"), F.col("transaction_id")).alias("evidence_id"), "transaction_id"
    )


# -- queue and look-ups -----------------------------------------------------------


@query(
    "risk_queue",
    f"""WITH {{TXN}}, {_SCORES} SELECT transaction_id, risk_score, risk_band,
  transaction_id IN (SELECT transaction_id FROM evidence) AS has_evidence FROM scores
WHERE risk_score >= 0.3 AND upper(risk_band) = 'HIGH' ORDER BY risk_score DESC, transaction_id LIMIT 25""",
)
def risk_queue(spark, folder):
    scores = _scores(spark, folder).drop("is_fraud", "device_key")
    return R.risk_queue(scores, _evidence(spark, folder), 25, min_score=0.3, band="high")


@query(
    "risk_queue_with_evidence",
    f"""WITH {{TXN}}, {_SCORES} SELECT transaction_id, risk_score, risk_band, true AS has_evidence FROM scores
WHERE transaction_id IN (SELECT transaction_id FROM evidence) ORDER BY risk_score DESC, transaction_id LIMIT 200""",
)
def risk_queue_with_evidence(spark, folder):
    scores = _scores(spark, folder).drop("is_fraud", "device_key")
    return R.risk_queue(scores, _evidence(spark, folder), 200, has_evidence=True)


@query(
    "has_evidence",
    f"""WITH {{TXN}}, {_SCORES} SELECT transaction_id, risk_band,
  transaction_id IN (SELECT transaction_id FROM evidence) AS has_evidence FROM scores""",
)
def has_evidence(spark, folder):
    out = R.with_evidence_flag(_scores(spark, folder), _evidence(spark, folder))
    return out.select("transaction_id", "risk_band", "has_evidence")


@query(
    "queue_filters",
    f"""WITH {{TXN}}, {_SCORES} SELECT transaction_id, risk_score FROM scores WHERE risk_score >= 0.3
  AND risk_band = 'MEDIUM' AND transaction_id NOT IN (SELECT transaction_id FROM evidence)""",
)
def queue_filters(spark, folder):
    flagged = R.with_evidence_flag(_scores(spark, folder), _evidence(spark, folder))
    return R.queue_filters(flagged, 0.3, "Medium", False).select("transaction_id", "risk_score")


@query(
    "top_by_score",
    f"WITH {{TXN}}, {_SCORES} SELECT transaction_id, risk_score FROM scores ORDER BY risk_score DESC, transaction_id LIMIT 50",
)
def top_by_score(spark, folder):
    return R.top_by_score(_scores(spark, folder).select("transaction_id", "risk_score"), 50)


_VERSIONS = """versions AS (SELECT transaction_id, 'v1' AS model_version, risk_score, ts AS scored_at FROM txn
  UNION ALL SELECT transaction_id, 'v2', risk_score * 0.5, ts + 60 FROM txn WHERE device_key IS NOT NULL
  UNION ALL SELECT transaction_id, 'v3', risk_score * 0.25, ts + 60 FROM txn WHERE addr_key IS NOT NULL)"""


def _versions(spark, folder):
    rows = transactions(spark, folder)
    entries = [
        F.when(
            F.col(scored).isNotNull(),
            F.struct(
                F.lit(version).alias("model_version"),
                (F.col("risk_score") * factor).alias("risk_score"),
                (F.col("ts") + later).alias("scored_at"),
            ),
        )
        for version, scored, factor, later in (
            ("v1", "transaction_id", 1.0, 0),
            ("v2", "device_key", 0.5, 60),
            ("v3", "addr_key", 0.25, 60),
        )
    ]
    return (
        rows.select("transaction_id", F.inline(F.array(*entries)))
        .filter(F.col("model_version").isNotNull())
        .withColumn("risk_band", risk_band(F.col("risk_score")))
    )


@query(
    "latest_scores",
    f"""WITH {{TXN}}, {_VERSIONS}, l AS (SELECT *, row_number() OVER (PARTITION BY transaction_id
   ORDER BY scored_at DESC, model_version DESC) AS rn FROM versions)
SELECT transaction_id, model_version, risk_score, {_BAND} AS risk_band, scored_at FROM l WHERE rn = 1""",
)
def latest_scores(spark, folder):
    return R.latest_scores(_versions(spark, folder))


@query(
    "score_summary",
    f"""WITH {{TXN}}, {_VERSIONS} SELECT model_version, count(*) AS rows_scored, round(avg(risk_score), 4) AS mean_score
FROM versions GROUP BY 1""",
)
def score_summary(spark, folder):
    return M.score_summary(_versions(spark, folder))


@query(
    "score_drift",
    f"""WITH {{TXN}}, {_VERSIONS} SELECT count(*) AS rows, round(max(abs(a.risk_score - b.risk_score)), 6) AS max_abs_diff,
  round(avg(abs(a.risk_score - b.risk_score)) + 1e-9, 6) AS mean_abs_diff
FROM versions a JOIN versions b USING (transaction_id) WHERE a.model_version = 'v1' AND b.model_version = 'v2'""",
)
def score_drift(spark, folder):
    rows = _versions(spark, folder)
    out = M.score_drift(rows.filter("model_version = 'v1'"), rows.filter("model_version = 'v2'"))
    return out.select("rows", F.round("max_abs_diff", 6).alias("max_abs_diff"), r6(F.col("mean_abs_diff")).alias("mean_abs_diff"))


@query(
    "scores_for",
    f"""WITH {{TXN}}, {_SCORES} SELECT transaction_id, risk_score, risk_band FROM scores
WHERE transaction_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def scores_for(spark, folder):
    ids = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("transaction_id"))
    return R.scores_for(ids, _scores(spark, folder)).select("transaction_id", "risk_score", "risk_band")


@query(
    "lookup",
    f"""WITH {{TXN}}, {_SCORES} SELECT evidence_id, transaction_id FROM evidence WHERE transaction_id IN
 (SELECT conv_id FROM conversations)""",
)
def lookup(spark, folder):
    ids = table(spark, folder, "conversations").select(F.col("conv_id").alias("transaction_id"))
    return R.lookup(_evidence(spark, folder), "transaction_id", ids)


@query(
    "coverage_status",
    """SELECT l_orderkey AS id, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) THEN 404
  WHEN NOT EXISTS (SELECT 1 FROM events WHERE event_id = l_orderkey) THEN 422
  WHEN NOT EXISTS (SELECT 1 FROM events WHERE event_id = l_orderkey AND event_type <> 'view') THEN 422 ELSE 200 END AS status
FROM (SELECT DISTINCT l_orderkey + 100 AS l_orderkey FROM lineitem)""",
)
def coverage_status(spark, folder):
    ids = table(spark, folder, "lineitem").select((F.col("l_orderkey") + 100).alias("id")).distinct()
    raw = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    base = table(spark, folder, "events").select(F.col("event_id").alias("id"), "event_type")
    return R.coverage_status(ids, raw, base, base.filter("event_type <> 'view'"), "id")


_LINKS = """links AS (
  SELECT 'CARD' AS entity_type, card_key AS entity_key, transaction_id, ts FROM txn
  UNION ALL SELECT 'DEVICE', device_key, transaction_id, ts FROM txn WHERE device_key IS NOT NULL
  UNION ALL SELECT 'ADDRESS', addr_key, transaction_id, ts FROM txn WHERE addr_key IS NOT NULL)"""


@query(
    "investigation_ready",
    f"""WITH {{TXN}}, {_SCORES}, {_LINKS}, c AS (SELECT transaction_id,
  (SELECT count(*) FROM scores s WHERE s.transaction_id = t.transaction_id AND risk_score >= 0.1) AS scores,
  (SELECT count(*) FROM evidence s WHERE s.transaction_id = t.transaction_id) AS evidence,
  (SELECT count(*) FROM links s WHERE s.transaction_id = t.transaction_id) AS links FROM txn t)
SELECT *, scores > 0 AND evidence > 0 AND links > 0 AS ready FROM c""",
)
def investigation_ready(spark, folder):
    txn = transactions(spark, folder)
    scores = _scores(spark, folder).filter("risk_score >= 0.1")
    return R.investigation_ready(txn, scores, _evidence(spark, folder), G.build_links(txn))


# -- metrics ------------------------------------------------------------------------

# Scores in steps of 1/200, so that many rows tie; rows without a device form a scored set of their own.
_SCORED = """scored AS (SELECT transaction_id, is_fraud, CASE WHEN device_key IS NULL THEN 'a' ELSE 'b' END AS grp,
  round(risk_score * 200) / 200 AS score FROM txn)"""


def _scored(spark, folder):
    return transactions(spark, folder).select(
        "transaction_id",
        "is_fraud",
        F.when(F.col("device_key").isNull(), "a").otherwise("b").alias("grp"),
        (F.round(F.col("risk_score") * 200) / 200).alias("score"),
    )


_CURVE = """curve AS (SELECT grp, score, count(*) AS n, sum(is_fraud) AS pos FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY grp) AS tn,
  sum(pos) OVER (PARTITION BY grp) AS tp FROM curve WINDOW w AS (PARTITION BY grp ORDER BY score DESC))"""


@query(
    "ranking_metrics",
    f"""WITH {{TXN}}, {_SCORED}, {_CURVE}, ranks AS (SELECT grp, is_fraud,
   rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0::DOUBLE AS r FROM scored),
auc AS (SELECT grp, (sum(r) FILTER (is_fraud = 1) - sum(is_fraud) * (sum(is_fraud) + 1) / 2.0::DOUBLE)
   / (sum(is_fraud) * (count(*) - sum(is_fraud))) AS roc FROM ranks GROUP BY 1)
SELECT grp, max(tn)::BIGINT AS n, max(tp)::BIGINT AS positives, round(sum(pos / tp * (cp / cn)) + 1e-9, 6) AS pr_auc,
  round(max(roc) + 1e-9, 6) AS roc_auc FROM cum JOIN auc USING (grp) GROUP BY grp""",
)
def ranking_metrics(spark, folder):
    out = X.ranking_metrics(_scored(spark, folder), "is_fraud", "score", ["grp"])
    return out.select("grp", "n", "positives", r6(F.col("pr_auc")).alias("pr_auc"), r6(F.col("roc_auc")).alias("roc_auc"))


_TOP = """top AS (SELECT grp, fraction, is_fraud, row_number() OVER (PARTITION BY grp, fraction ORDER BY score DESC, transaction_id) AS rn,
   greatest(1, round_even(count(*) OVER (PARTITION BY grp, fraction) * fraction, 0))::BIGINT AS k,
   sum(is_fraud) OVER (PARTITION BY grp, fraction) AS p
  FROM scored, (VALUES (0.01::DOUBLE), (0.001::DOUBLE)) f(fraction)),
tops AS (SELECT grp, fraction, k, round(sum(is_fraud) FILTER (rn <= k) / max(k), 5) AS precision_at,
   round(sum(is_fraud) FILTER (rn <= k) / greatest(max(p), 1), 5) AS recall_at FROM top GROUP BY grp, fraction, k)"""


@query("top_fraction_metrics", f"WITH {{TXN}}, {_SCORED}, {_TOP} SELECT * FROM tops")
def top_fraction_metrics(spark, folder):
    return X.top_fraction_metrics(_scored(spark, folder), "is_fraud", "score", "transaction_id", ["grp"])


_LEVELS = [0.80 + (0.9995 - 0.80) * i / 199 for i in range(200)]
_BEST = f"""cands AS (SELECT DISTINCT grp, unnest(quantile_cont(score, {_LEVELS})) AS t FROM scored GROUP BY grp),
f1s AS (SELECT c.grp, c.t, 2.0::DOUBLE * sum((score >= t AND is_fraud = 1)::INT) / (sum((score >= t)::INT) + sum(is_fraud)) AS f1
   FROM cands c JOIN scored s USING (grp) GROUP BY ALL),
best AS (SELECT grp, t AS threshold, f1 FROM f1s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, t) = 1)"""


@query(
    "best_f1_threshold",
    f"WITH {{TXN}}, {_SCORED}, {_BEST} SELECT grp, round(threshold + 1e-9, 6) AS threshold, round(f1 + 1e-9, 6) AS f1 FROM best",
)
def best_f1_threshold(spark, folder):
    out = X.best_f1_threshold(_scored(spark, folder), "is_fraud", "score", ["grp"])
    return out.select("grp", r6(F.col("threshold")).alias("threshold"), r6(F.col("f1")).alias("f1"))


_CONFUSION = """conf AS (SELECT grp, 0.6::DOUBLE AS threshold, count(*) FILTER (score < 0.6 AND is_fraud = 0) AS tn,
  count(*) FILTER (score >= 0.6 AND is_fraud = 0) AS fp, count(*) FILTER (score < 0.6 AND is_fraud = 1) AS fn,
  count(*) FILTER (score >= 0.6 AND is_fraud = 1) AS tp FROM scored GROUP BY 1),
confm AS (SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0) + 1e-9, 6) AS "precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0) + 1e-9, 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + 1e-9, 6) AS f1 FROM conf)"""


def _confusion_shown(df):
    names = ("precision", "recall", "f1", "pr_auc", "roc_auc")
    return df.select(*[r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


@query("confusion", f"WITH {{TXN}}, {_SCORED}, {_CONFUSION} SELECT * FROM confm")
def confusion(spark, folder):
    scored = _scored(spark, folder)
    thresholds = scored.select("grp").distinct().withColumn("threshold", F.lit(0.6))
    return _confusion_shown(X.confusion(scored, "is_fraud", "score", ["grp"], thresholds))


@query(
    "full_metrics",
    f"""WITH {{TXN}}, {_SCORED}, {_CURVE}, {_TOP}, {_CONFUSION}, ranks AS (SELECT grp, is_fraud,
   rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0::DOUBLE AS r FROM scored),
auc AS (SELECT grp, (sum(r) FILTER (is_fraud = 1) - sum(is_fraud) * (sum(is_fraud) + 1) / 2.0::DOUBLE)
   / (sum(is_fraud) * (count(*) - sum(is_fraud))) AS roc FROM ranks GROUP BY 1),
pr AS (SELECT grp, max(tn)::BIGINT AS n, max(tp)::BIGINT AS positives, round(sum(pos / tp * (cp / cn)) + 1e-9, 6) AS pr_auc FROM cum GROUP BY 1),
p AS (SELECT grp, max(precision_at) FILTER (fraction = 0.01) AS precision_at_01, max(recall_at) FILTER (fraction = 0.01) AS recall_at_01,
  max(precision_at) FILTER (fraction = 0.001) AS precision_at_001, max(recall_at) FILTER (fraction = 0.001) AS recall_at_001
  FROM tops GROUP BY 1)
SELECT grp, n, positives, pr_auc, round(roc + 1e-9, 6) AS roc_auc, precision_at_01, recall_at_01, precision_at_001, recall_at_001,
  threshold, tn, fp, fn, tp, "precision", recall, f1
FROM pr JOIN auc USING (grp) JOIN p USING (grp) JOIN confm USING (grp)""",
)
def full_metrics(spark, folder):
    scored = _scored(spark, folder)
    thresholds = scored.select("grp").distinct().withColumn("threshold", F.lit(0.6))
    return _confusion_shown(X.full_metrics(scored, "is_fraud", "score", "transaction_id", ["grp"], thresholds))


_WEIGHT = " + ".join(f"(u >= '{step!r}'::DOUBLE)::INT" for step in X.poisson_steps())


@query(
    "paired_bootstrap",
    f"""WITH {{TXN}}, {_SCORED}, h AS (SELECT scored.*, k, sha256(transaction_id || ':' || k || ':42') AS hash
  FROM scored, range(50) AS rounds(k)),
u AS (SELECT grp, is_fraud, score, k * 4 + i AS replicate, ('0x' || substr(hash, (1 + 13 * i)::INT, 13))::BIGINT / 4503599627370496 AS u
  FROM h, range(4) AS places(i)),
w AS (SELECT *, {_WEIGHT} AS w FROM u),
sides AS (SELECT grp, replicate, 'base' AS side, score, w, w * is_fraud AS wy FROM w WHERE w > 0
  UNION ALL SELECT grp, replicate, 'other', (score + is_fraud * '0.2'::DOUBLE) / '1.2'::DOUBLE, w, w * is_fraud FROM w WHERE w > 0),
c AS (SELECT grp, replicate, side, score, sum(w) AS n, sum(wy) AS pos FROM sides GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(pos) OVER (PARTITION BY grp, replicate, side) AS tp
  FROM c WINDOW o AS (PARTITION BY grp, replicate, side ORDER BY score DESC)),
ap AS (SELECT grp, replicate, side, sum(pos * (cp / cn)) / nullif(max(tp), 0) AS ap FROM cum GROUP BY ALL),
gains AS (SELECT grp, replicate, max(ap) FILTER (side = 'other') - max(ap) FILTER (side = 'base') AS gain FROM ap GROUP BY ALL)
SELECT grp, count(*) AS replicates, round(avg(gain) + 1e-9, 6) AS mean_gain, round(quantile_cont(gain, 0.025) + 1e-9, 6) AS low,
  round(quantile_cont(gain, 0.975) + 1e-9, 6) AS high, round(avg((gain > 0)::INT) + 1e-9, 6) AS share_positive FROM gains GROUP BY 1""",
)
def paired_bootstrap(spark, folder):
    scored = _scored(spark, folder).withColumn("other", (F.col("score") + F.col("is_fraud") * 0.2) / 1.2)
    out = X.paired_bootstrap(scored, "is_fraud", "score", "other", "transaction_id", ["grp"])
    return out.select(
        "grp", "replicates", *[r6(F.col(c)).alias(c) for c in ("mean_gain", "low", "high", "share_positive")]
    )


# -- model ----------------------------------------------------------------------------


@query(
    "top_contributions",
    """WITH {TXN}, v AS (SELECT transaction_id, amount AS a, ts / 1e5 AS b, CASE WHEN device_key IS NOT NULL THEN device_key::DOUBLE END AS c FROM txn),
m AS (SELECT *, (a + b + coalesce(c, 0)) / CASE WHEN c IS NULL THEN 2 ELSE 3 END AS mean FROM v),
e AS (SELECT transaction_id, 'a' AS feature, 0 AS pos, a AS value, 0.5 * abs(a - mean) AS contribution FROM m
 UNION ALL SELECT transaction_id, 'b', 1, b, 0.3 * abs(b - mean) FROM m
 UNION ALL SELECT transaction_id, 'c', 2, c, coalesce(0.2 * abs(c - mean), 0) FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY contribution DESC, pos) AS abs_rank FROM e)
SELECT transaction_id, abs_rank, feature, round(value + 1e-9, 6) AS value, round(contribution + 1e-9, 6) AS contribution,
 CASE WHEN contribution > 0 THEN 'positive' ELSE 'neutral' END AS direction FROM r WHERE abs_rank <= 2""",
)
def top_contributions(spark, folder):
    rows = transactions(spark, folder).select(
        "transaction_id", F.col("amount").alias("a"), (F.col("ts") / 1e5).alias("b"), F.col("device_key").cast("double").alias("c")
    )
    out = M.top_contributions(rows, {"a": 0.5, "b": 0.3, "c": 0.2}, k=2)
    return out.select(
        "transaction_id", F.col("abs_rank").cast("long").alias("abs_rank"), "feature",
        r6(F.col("value")).alias("value"), r6(F.col("contribution")).alias("contribution"), "direction",
    )


# Trained models by session and folder, so that several queries share one training.
_MODELS = {}


def _trained(spark, folder, relational=True):
    key = (spark.sparkContext.applicationId, folder, relational)
    if key not in _MODELS:
        _MODELS[key] = _train(spark, folder, relational)
    return _MODELS[key]


def _train(spark, folder, relational):
    matrix = model_matrix(spark, folder, relational)
    inputs = [c for c in matrix.columns if c not in ("transaction_id", "split", "is_fraud")]
    filled, names = M.fill_missing(matrix, inputs)
    filled = cut_lineage(filled)
    return M.train_classifier(filled, names), filled, names


@query("train_and_score")
def train_and_score(spark, folder):
    model, filled, _ = _trained(spark, folder)
    return M.score_rows(model, filled, "gbt-1")


def _work(spark, name):
    """A new place in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@query(
    "batch_score",
    """WITH {TXN} SELECT transaction_id, 'gbt-1' AS model_version, true AS in_range, true AS band_follows FROM txn
UNION ALL SELECT transaction_id, 'kept', true, true FROM txn WHERE is_fraud = 1""",
)
def batch_score(spark, folder):
    """Stored scores after a batch run over a store that holds a stale run and another version."""
    model, filled, _ = _trained(spark, folder, relational=False)
    place = _work(spark, "scores")
    stale = filled.select(
        "transaction_id", F.lit("gbt-1").alias("model_version"), F.lit(2.0).alias("risk_score"), F.lit("LOW").alias("risk_band")
    )
    other = filled.filter("is_fraud = 1").select(
        "transaction_id", F.lit("kept").alias("model_version"), F.lit(0.7).alias("risk_score"), F.lit("HIGH").alias("risk_band")
    )
    T.replace_version(stale.unionByName(other), place)
    M.batch_score(model, filled, "gbt-1", place)
    return spark.read.parquet(place).select(
        "transaction_id",
        "model_version",
        F.col("risk_score").between(0, 1).alias("in_range"),
        (F.col("risk_band") == risk_band(F.col("risk_score"))).alias("band_follows"),
    )


@query(
    "reload_drift",
    "SELECT count(*) AS rows, 0::DOUBLE AS max_abs_diff, 0::DOUBLE AS mean_abs_diff FROM events",
)
def reload_drift(spark, folder):
    """Scores of a model before and after it is saved and loaded."""
    model, filled, _ = _trained(spark, folder, relational=False)
    place = _work(spark, "model")
    M.save_model(model, place)
    return M.score_drift(M.score_rows(model, filled, "kept"), M.score_rows(M.load_model(place), filled, "loaded"))


@query(
    "trained_contributions",
    "WITH {TXN} SELECT transaction_id, 5 AS listed, true AS falling FROM txn",
)
def trained_contributions(spark, folder):
    """Per transaction, how many inputs the trained model's weights list, and whether they fall."""
    model, filled, _ = _trained(spark, folder, relational=False)
    top = M.top_contributions(filled, M.importances(model))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("abs_rank", "contribution"))), lambda e: e["contribution"])
    return top.groupBy("transaction_id").agg(
        F.count("*").cast("int").alias("listed"), (F.sort_array(listed, asc=False) == listed).alias("falling")
    )


@query("score_missing")
def score_missing(spark, folder):
    model, filled, _ = _trained(spark, folder, relational=False)
    stored = filled.filter("is_fraud = 0").select("transaction_id", F.lit("gbt-1").alias("model_version"))
    return M.score_missing(model, filled, stored, "gbt-1")


@query("shuffled_control")
def shuffled_control(spark, folder):
    """Test metrics with relational inputs of the own row and of a random row of the same split."""
    matrix = cut_lineage(model_matrix(spark, folder))
    shuffled = cut_lineage(M.shuffle_features(matrix, M.MODEL_RELATIONAL, ["split"]))
    scored = []
    for version, rows in (("aligned", matrix), ("shuffled", shuffled)):
        inputs = [c for c in rows.columns if c not in ("transaction_id", "split", "is_fraud")]
        filled, names = M.fill_missing(rows, inputs)
        scored.append(M.score_rows(M.train_classifier(filled, names), filled, version))
    labels = matrix.filter("split = 'test'").select("transaction_id", "is_fraud")
    both = scored[0].unionByName(scored[1]).join(labels, "transaction_id", "inner")
    return X.ranking_metrics(both, "is_fraud", "risk_score", ["model_version"])


@query(
    "shuffled_features",
    """SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS donors, sum(event_id)::BIGINT AS id_sum, true AS some_moved
FROM events GROUP BY 1""",
)
def shuffled_features(spark, folder):
    """Each row of a group gets the features of exactly one row of the same group."""
    rows = table(spark, folder, "events").select("event_id", "event_type", F.col("event_id").alias("own"), F.col("event_type").alias("kind"))
    out = M.shuffle_features(rows, ["own", "kind"], ["event_type"], "event_id")
    return out.filter("kind = event_type").groupBy("event_type").agg(
        F.count("*").alias("rows"),
        F.count_distinct("own").alias("donors"),
        F.sum("own").alias("id_sum"),
        F.bool_or(F.col("own") != F.col("event_id")).alias("some_moved"),
    )


# -- entity risk ------------------------------------------------------------------------


@query(
    "entity_risk_asof",
    f"""WITH {{TXN}}, {_LINKS}, lab AS (SELECT transaction_id, is_fraud AS value, ts + (1 + transaction_id % 10) * 86400 AS arrival
  FROM txn WHERE event_type IN ('error', 'purchase')),
q AS (SELECT DISTINCT entity_type, entity_key, ts AS as_of FROM links
  UNION SELECT 'CARD', 'nobody ' || n_nationkey, 86400 FROM nation)
SELECT q.entity_type, q.entity_key, as_of, coalesce(sum(value), 0)::BIGINT AS fraud_count, count(value) AS label_count,
  round(sum(value) / count(value) + 1e-9, 6) AS fraud_rate, 1704067200 + as_of - 7 * 86400 AS boundary_s,
  CASE WHEN max(l.transaction_id) IS NULL THEN 'no linked transactions' ELSE '' END AS note
FROM q LEFT JOIN links l ON l.entity_type = q.entity_type AND l.entity_key = q.entity_key
 LEFT JOIN lab ON lab.transaction_id = l.transaction_id AND arrival <= as_of - 7 * 86400
GROUP BY ALL""",
)
def entity_risk_asof(spark, folder):
    txn = transactions(spark, folder)
    links = G.build_links(txn)
    kind = table(spark, folder, "events").select(F.col("event_id").alias("transaction_id"), "event_type")
    labels = txn.join(kind.filter(F.col("event_type").isin("error", "purchase")), "transaction_id", "left_semi").select(
        "transaction_id",
        F.col("is_fraud").alias("value"),
        (F.col("ts") + (F.col("transaction_id") % 10 + 1) * DAY_S).alias("arrival"),
    )
    strangers = table(spark, folder, "nation").select(
        F.lit("CARD").alias("entity_type"),
        F.concat(F.lit("nobody "), F.col("n_nationkey")).alias("entity_key"),
        F.lit(DAY_S).cast("long").alias("as_of"),
    )
    queries = links.select("entity_type", "entity_key", F.col("ts").alias("as_of")).distinct().unionByName(strangers)
    out = ER.entity_risk_asof(links, labels, queries, 7, EVENTS_ANCHOR_S)
    return out.select(
        "entity_type", "entity_key", "as_of", "fraud_count", "label_count", r6(F.col("fraud_rate")).alias("fraud_rate"),
        F.unix_seconds("eligible_boundary").alias("boundary_s"), "note",
    )


# -- cases --------------------------------------------------------------------------------

_STATUS = "['NEW','INVESTIGATING','ESCALATED','CONFIRMED_FRAUD','CLOSED','FALSE_POSITIVE','NEW','BOGUS']"
_HISTORY = f"""history AS (SELECT conv_id AS case_id, turn AS seq, CASE WHEN turn = 0 THEN 'NEW' ELSE
  ({_STATUS})[((turn + conv_id % 3) % 6 + 1)::INT] END AS status, turn * 60 AS "at", role AS actor FROM conversations)"""
_NAMES = ("NEW", "INVESTIGATING", "ESCALATED", "CONFIRMED_FRAUD", "CLOSED", "FALSE_POSITIVE", "NEW", "BOGUS")


def _pick(position):
    return F.element_at(F.array(*[F.lit(s) for s in _NAMES]), position.cast("int"))


def _history(spark, folder):
    turn, conv = F.col("turn"), F.col("conv_id")
    status = F.when(turn == 0, "NEW").otherwise(_pick((turn + conv % 3) % 6 + 1))
    return table(spark, folder, "conversations").select(
        conv.alias("case_id"), turn.alias("seq"), status.alias("status"), (turn * 60).alias("at"), F.col("role").alias("actor")
    )


_LEGAL = """((previous = 'NEW' AND status IN ('INVESTIGATING', 'ESCALATED'))
 OR (previous = 'INVESTIGATING' AND status IN ('ESCALATED', 'CONFIRMED_FRAUD', 'FALSE_POSITIVE'))
 OR (previous = 'ESCALATED' AND status IN ('INVESTIGATING', 'CONFIRMED_FRAUD', 'FALSE_POSITIVE'))
 OR (previous IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE') AND status = 'CLOSED'))"""


@query(
    "validate_transitions",
    f"""WITH {_HISTORY}, p AS (SELECT *, lag(status) OVER (PARTITION BY case_id ORDER BY seq) AS previous FROM history)
SELECT case_id, seq, previous, status, CASE WHEN previous IS NULL THEN status = 'NEW' ELSE {_LEGAL} END AS legal FROM p""",
)
def validate_transitions(spark, folder):
    return K.validate_transitions(_history(spark, folder))


@query(
    "case_status",
    f"""WITH {_HISTORY} SELECT case_id, arg_max(status, seq) AS status, max("at") AS updated_at, count(*) AS steps
FROM history GROUP BY 1""",
)
def case_status(spark, folder):
    return K.case_status(_history(spark, folder))


_ACTIONS = f"""actions AS (SELECT conv_id AS case_id, turn AS seq,
  CASE WHEN turn % 5 = 4 THEN 'NOTE' WHEN (conv_id * 7 + turn * 3) % 8 IN (3, 5) THEN 'DECISION' ELSE 'STATUS' END AS action,
  ({_STATUS})[((conv_id * 7 + turn * 3) % 8 + 1)::INT] AS target, (conv_id + turn) % 7 <> 0 AS acceptable FROM conversations)"""


def _actions(spark, folder):
    turn, conv = F.col("turn"), F.col("conv_id")
    code = (conv * 7 + turn * 3) % 8
    return table(spark, folder, "conversations").select(
        conv.alias("case_id"),
        turn.alias("seq"),
        F.when(turn % 5 == 4, "NOTE").when(code.isin(3, 5), "DECISION").otherwise("STATUS").alias("action"),
        _pick(code + 1).alias("target"),
        ((conv + turn) % 7 != 0).alias("acceptable"),
    )


_REASON = f"""CASE WHEN action = 'NOTE' THEN NULL
  WHEN action = 'STATUS' AND target = 'BOGUS' THEN 'unknown_status'
  WHEN action = 'STATUS' AND target IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE') THEN 'decision_required'
  WHEN action = 'DECISION' AND target NOT IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE') THEN 'unknown_decision'
  WHEN NOT acceptable THEN 'bad_reference'
  WHEN action = 'STATUS' AND target = previous THEN 'same_status'
  WHEN action = 'STATUS' AND NOT {_LEGAL.replace("status IN", "target IN").replace("status = 'CLOSED'", "target = 'CLOSED'")} THEN 'illegal_transition'
  WHEN action = 'DECISION' AND previous NOT IN ('INVESTIGATING', 'ESCALATED') THEN 'not_decidable' END"""


_REPLAY = f"""WITH RECURSIVE {_ACTIONS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS rn FROM actions),
run AS (SELECT case_id, rn, seq, action, target, previous, reason,
   CASE WHEN reason IS NULL AND action <> 'NOTE' THEN target ELSE previous END AS status_after
  FROM (SELECT *, {_REASON} AS reason FROM (SELECT *, 'NEW' AS previous FROM numbered WHERE rn = 1))
 UNION ALL SELECT case_id, rn, seq, action, target, previous, reason,
   CASE WHEN reason IS NULL AND action <> 'NOTE' THEN target ELSE previous END
  FROM (SELECT *, {_REASON} AS reason FROM (SELECT n.*, r.status_after AS previous FROM run r
    JOIN numbered n ON n.case_id = r.case_id AND n.rn = r.rn + 1)))
SELECT case_id, seq, action, target, previous AS status_before, reason IS NULL AS accepted, reason, status_after FROM run"""


@query("replay_actions", _REPLAY)
def replay_actions(spark, folder):
    return K.replay_actions(_actions(spark, folder))


@query(
    "replay_actions_sparse",
    f"SELECT * REPLACE (1704067200000000 + seq * 977000000 + case_id * 7 AS seq) FROM ({_REPLAY})",
)
def replay_actions_sparse(spark, folder):
    """The same log with time stamps in microseconds as sequence numbers."""
    stamped = _actions(spark, folder).withColumn("seq", F.lit(1704067200000000) + F.col("seq") * 977000000 + F.col("case_id") * 7)
    return K.replay_actions(stamped)


_REQUESTS = """requests AS (SELECT o_orderkey AS request_id, o_custkey AS transaction_id, o_orderstatus <> 'O' AS needs_evidence,
  CASE o_orderkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['ev-' || o_custkey] WHEN 2 THEN ['ev-' || o_custkey, 'ev-' || o_custkey]
   WHEN 3 THEN ['ev-' || o_custkey, 'ev-' || (o_custkey + 1)] ELSE ['nothing'] END AS evidence_ids FROM orders),
covered AS (SELECT transaction_id FROM txn WHERE amount >= 30)"""


def _requests(spark, folder):
    own = F.concat(F.lit("ev-"), F.col("o_custkey"))
    code = F.col("o_orderkey") % 5
    none = F.array().cast("array<string>")
    ids = (
        F.when(code == 0, none)
        .when(code == 1, F.array(own))
        .when(code == 2, F.array(own, own))
        .when(code == 3, F.array(own, F.concat(F.lit("ev-"), F.col("o_custkey") + 1)))
        .otherwise(F.array(F.lit("nothing")))
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("transaction_id"),
        (F.col("o_orderstatus") != "O").alias("needs_evidence"),
        ids.alias("evidence_ids"),
    )


@query(
    "validate_references",
    f"""WITH {{TXN}}, {_SCORES}, {_REQUESTS}, f AS (SELECT r.*, transaction_id IN (SELECT transaction_id FROM covered) AS cov,
   transaction_id IN (SELECT transaction_id FROM evidence) AS known FROM requests r),
c AS (SELECT request_id, count(*) FILTER (e.transaction_id IS NULL) AS unk, count(*) FILTER (e.transaction_id <> x.transaction_id) AS fgn
  FROM (SELECT request_id, transaction_id, unnest(evidence_ids) AS eid FROM requests) x LEFT JOIN evidence e ON e.evidence_id = eid GROUP BY 1),
t AS (SELECT request_id, list_filter([CASE WHEN NOT cov AND NOT known THEN 'unknown_transaction' END,
  CASE WHEN NOT cov AND known THEN 'transaction_not_covered' END,
  CASE WHEN needs_evidence AND len(evidence_ids) = 0 THEN 'evidence_required' END,
  CASE WHEN len(evidence_ids) <> len(list_distinct(evidence_ids)) THEN 'duplicate_evidence' END,
  CASE WHEN unk > 0 THEN 'unknown_evidence' END, CASE WHEN fgn > 0 THEN 'foreign_evidence' END], lambda x: x IS NOT NULL) AS rs
  FROM f LEFT JOIN c USING (request_id))
SELECT request_id, len(rs) = 0 AS acceptable, array_to_string(rs, ',') AS reasons FROM t""",
)
def validate_references(spark, folder):
    covered = transactions(spark, folder).filter("amount >= 30")
    return K.validate_references(_requests(spark, folder), _evidence(spark, folder), covered)


_CASES = """cases AS (SELECT c_custkey AS case_id, c_custkey AS transaction_id,
  CASE c_nationkey % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'ESCALATED' ELSE 'CLOSED' END AS status,
  c_custkey * 7 % 100 AS opened_at, ['ev-' || c_custkey, 'ev-' || (c_custkey // 2), 'ev-' || c_custkey] AS ids FROM customer),
decisions AS (SELECT o_orderkey AS decision_id, o_custkey AS case_id, o_custkey AS transaction_id,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'CONFIRMED_FRAUD'
       WHEN o_orderpriority LIKE '3%' THEN 'FALSE_POSITIVE' ELSE 'DEFERRED' END AS decision,
  o_orderdate + INTERVAL 1500 MILLISECOND AS decided_at FROM orders)"""


def _cases(spark, folder):
    key = F.col("c_custkey")
    part = F.col("c_nationkey") % 3
    return table(spark, folder, "customer").select(
        key.alias("case_id"),
        key.alias("transaction_id"),
        F.when(part == 0, "NEW").when(part == 1, "ESCALATED").otherwise("CLOSED").alias("status"),
        (key * 7 % 100).alias("opened_at"),
        F.array(
            F.concat(F.lit("ev-"), key), F.concat(F.lit("ev-"), F.floor(key / 2)), F.concat(F.lit("ev-"), key)
        ).alias("evidence_ids"),
    )


def _decisions(spark, folder):
    rank = F.substring("o_orderpriority", 1, 1)
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("decision_id"),
        F.col("o_custkey").alias("case_id"),
        F.col("o_custkey").alias("transaction_id"),
        F.when(rank.isin("1", "2"), "CONFIRMED_FRAUD").when(rank == "3", "FALSE_POSITIVE").otherwise("DEFERRED").alias("decision"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '1.5' SECOND")).alias("decided_at"),
    )


@query(
    "case_queue",
    f"""WITH {{TXN}}, {_SCORES}, {_CASES}, d AS (SELECT case_id, arg_max(decision, (decided_at, decision_id)) AS latest_decision,
   epoch(max(decided_at))::BIGINT AS decided_s FROM decisions GROUP BY 1)
SELECT case_id, transaction_id, status, opened_at, risk_score, risk_band, len(list_distinct(ids)) AS evidence_count,
  latest_decision, decided_s FROM cases LEFT JOIN scores USING (transaction_id) LEFT JOIN d USING (case_id) WHERE status = 'ESCALATED'""".replace(
        "epoch(max(decided_at))::BIGINT", "floor(epoch(max(decided_at)))::BIGINT"
    ),
)
def case_queue(spark, folder):
    out = K.case_queue(_cases(spark, folder), _scores(spark, folder), _decisions(spark, folder), "ESCALATED")
    return out.withColumn("decided_s", F.unix_seconds("decided_at")).drop("decided_at")


@query(
    "case_detail",
    f"""WITH {_HISTORY}, d AS (SELECT conv_id AS case_id, 'note' AS section, turn AS seq, role AS item_id, text FROM conversations
  UNION ALL SELECT case_id, 'history', seq, actor, status FROM history)
SELECT case_id, section, row_number() OVER (PARTITION BY case_id, section ORDER BY seq) AS position, item_id, text FROM d""",
)
def case_detail(spark, folder):
    notes = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("seq"), F.col("role").alias("item_id"), "text"
    )
    history = _history(spark, folder).select("case_id", "seq", F.col("actor").alias("item_id"), F.col("status").alias("text"))
    return K.case_detail({"note": notes, "history": history})


@query(
    "labels_from_decisions",
    f"""WITH {_CASES} SELECT decision_id, case_id, transaction_id, (decision = 'CONFIRMED_FRAUD')::INT AS value,
  floor(epoch(decided_at))::BIGINT AS arrival_s, 'reviewer' AS source FROM decisions WHERE decision <> 'DEFERRED'""",
)
def labels_from_decisions(spark, folder):
    out = K.labels_from_decisions(_decisions(spark, folder))
    exact = F.col("arrival_at").cast("double").cast("long")
    return out.withColumn("arrival_s", exact).drop("arrival_at")


@query(
    "audit_decisions",
    f"""WITH {_CASES}, d AS (SELECT case_id, count(*) AS decisions FROM decisions WHERE decision <> 'DEFERRED' GROUP BY 1),
l AS (SELECT case_id, count(*) AS labels FROM decisions WHERE decision = 'CONFIRMED_FRAUD' GROUP BY 1)
SELECT case_id, decisions, coalesce(labels, 0) AS labels,
 decisions <= 1 AND coalesce(labels, 0) <= 1 AND decisions = coalesce(labels, 0) AS consistent FROM d LEFT JOIN l USING (case_id)""",
)
def audit_decisions(spark, folder):
    decisions = _decisions(spark, folder)
    labels = K.labels_from_decisions(decisions).filter("value = 1")
    return K.audit_decisions(decisions, labels)


@query(
    "json_list",
    f"""WITH {_CASES} SELECT case_id, '["' || array_to_string(list_sort(list_distinct(ids)), '","') || '"]' AS ids,
  len(list_distinct(ids)) AS parsed FROM cases""",
)
def json_list(spark, folder):
    text = K.json_list(F.col("evidence_ids"))
    return _cases(spark, folder).select(
        "case_id", text.alias("ids"), F.size(K.parse_json_list(text)).cast("long").alias("parsed")
    )


@query(
    "canonical_json",
    """SELECT o_orderkey, '{"a":' || o_custkey || ',"b":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END
  || ',"c":"' || o_orderpriority || '"}' AS payload, sha256('{"a":' || o_custkey || ',"b":' ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || ',"c":"' || o_orderpriority || '"}') AS hash FROM orders""",
)
def canonical_payload(spark, folder):
    payload = canonical_json(
        {
            "c": F.col("o_orderpriority"),
            "a": F.col("o_custkey"),
            "b": F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderstatus")),
            "generated_at": F.col("o_orderdate").cast("string"),
        }
    )
    return table(spark, folder, "orders").select("o_orderkey", payload.alias("payload"), content_hash(payload).alias("hash"))


# -- stored tables ------------------------------------------------------------------------


@query("read_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def read_columns(spark, folder):
    return T.read_columns(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_totalprice"])


@query(
    "align_schema",
    """SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def align_schema(spark, folder):
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return T.align_schema(old, new)


@query(
    "upsert_by_key",
    """WITH m AS (SELECT c_custkey AS k, c_acctbal AS v, 0 AS new, 0 AS "at" FROM customer
  UNION ALL SELECT o_custkey, o_totalprice, 1, o_orderkey FROM orders)
SELECT k, v, "at" FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY new DESC, "at" DESC) = 1""",
)
def upsert_by_key(spark, folder):
    stored = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("long").alias("at")
    )
    incoming = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("at")
    )
    return T.upsert_by_key(stored, incoming, ["k"], "at")


@query(
    "append_if_absent",
    """SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL
SELECT o_custkey + 10, min(o_totalprice) FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1""",
)
def append_if_absent(spark, folder):
    stored = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    incoming = table(spark, folder, "orders").select((F.col("o_custkey") + 10).alias("k"), F.col("o_totalprice").alias("v"))
    return T.append_if_absent(stored, incoming, "k")


@query(
    "replace_version",
    """SELECT c_custkey AS id, c_acctbal AS value, 'v1' AS model_version FROM customer
UNION ALL SELECT o_orderkey, o_totalprice, 'v2' FROM orders""",
)
def replace_version(spark, folder):
    """A second write of one version replaces its rows alone."""
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    first = customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    second = orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    place = _work(spark, "versions")
    both = first.withColumn("model_version", F.lit("v1")).unionByName(first.withColumn("model_version", F.lit("v2")))
    T.replace_version(both, place)
    T.replace_version(second.withColumn("model_version", F.lit("v2")), place)
    return spark.read.parquet(place)


@query("read_typed_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def read_typed_csv(spark, folder):
    """Orders written as CSV, read with their types and stored as parquet."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    place = _work(spark, "csv")
    orders.write.csv(place, header=True)
    return T.csv_to_parquet(spark, place, orders.schema, _work(spark, "typed"))


@query(
    "table_fingerprint",
    """WITH c AS (SELECT o_custkey::VARCHAR AS a, o_orderkey::VARCHAR AS b, o_orderpriority AS c, o_orderstatus AS d,
  o_totalprice::DECIMAL(18,2)::VARCHAR AS e FROM orders),
t AS (SELECT coalesce(length(a) || ':' || a, '-') || coalesce(length(b) || ':' || b, '-') || coalesce(length(c) || ':' || c, '-')
  || coalesce(length(d) || ':' || d, '-') || coalesce(length(e) || ':' || e, '-') AS row_text FROM c)
SELECT count(*) AS rows, coalesce(sum(('0x' || substr(md5(row_text), 1, 15))::BIGINT), 0)::VARCHAR AS content FROM t""",
)
def table_fingerprint(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice")
    )
    return T.table_fingerprint(orders)
