"""Queries over links, neighbourhoods, components and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.scalars import day_of, hour_of, risk_band
from ledgerlens.operators import components as C
from ledgerlens.operators import evidence as E
from ledgerlens.operators import graph as G
from ledgerlens.operators import history as H
from ledgerlens.plans.features import _STRICT, _history_sql
from ledgerlens.plans.registry import query, r6
from ledgerlens.plans.tables import transactions

# Every transaction is a seed. The tight limits prune and cap on small data as well.
DEFAULT = G.ExpansionParams()
TIGHT = G.ExpansionParams(hub_degree_max=110, neighbor_cap=20)


def graph_query(name, sql=None):
    """Register a query of (spark, folder, params) with the default limits and, as ``<name>_tight``, with the tight ones."""

    def register(fn):
        for suffix, params in (("", DEFAULT), ("_tight", TIGHT)):
            limits = {"{HUB}": str(params.hub_degree_max), "{CAP}": str(params.neighbor_cap)}
            text = sql
            for mark, value in limits.items():
                text = text and text.replace(mark, value)
            query(name + suffix, text)(lambda spark, folder, params=params: fn(spark, folder, params))
        return fn

    return register


_LINKS = """links AS (
  SELECT 'CARD' AS entity_type, card_key AS entity_key, transaction_id, ts FROM txn
  UNION ALL SELECT 'DEVICE', device_key, transaction_id, ts FROM txn WHERE device_key IS NOT NULL
  UNION ALL SELECT 'ADDRESS', addr_key, transaction_id, ts FROM txn WHERE addr_key IS NOT NULL),
deg AS (SELECT entity_type, entity_key, count(*) AS degree FROM links GROUP BY ALL)"""

_KEPT = f"""{_LINKS},
kept AS (SELECT links.* FROM links JOIN deg USING (entity_type, entity_key) WHERE degree <= {{HUB}})"""

_EXPAND = f"""{_KEPT},
cand AS (SELECT s.transaction_id AS seed_id, m.entity_type, m.entity_key, m.transaction_id AS member_id,
    m.ts AS member_ts,
    row_number() OVER (PARTITION BY s.transaction_id, m.entity_type, m.entity_key ORDER BY m.ts DESC, m.transaction_id DESC) AS rn,
    count(*) OVER (PARTITION BY s.transaction_id, m.entity_type, m.entity_key) AS in_window
  FROM kept s JOIN kept m ON s.entity_type = m.entity_type AND s.entity_key = m.entity_key
   AND m.ts >= s.ts - 14 * 86400 AND m.ts < s.ts + 2 * 86400),
members AS (SELECT DISTINCT seed_id, member_id, member_ts FROM cand WHERE rn <= {{CAP}}
  UNION SELECT transaction_id, transaction_id, ts FROM txn)"""


def _links(spark, folder):
    txn = transactions(spark, folder)
    return txn, G.build_links(txn)


@query("build_links", f"WITH {{TXN}}, {_LINKS} SELECT * FROM links")
def build_links(spark, folder):
    return _links(spark, folder)[1]


@query(
    "link_stats",
    f"WITH {{TXN}}, {_LINKS} SELECT (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM deg) AS entities",
)
def link_stats(spark, folder):
    return G.link_stats(_links(spark, folder)[1])


@graph_query("entity_degree", f"WITH {{TXN}}, {_LINKS} SELECT *, degree > {{HUB}} AS is_hub FROM deg")
def entity_degree(spark, folder, params):
    return G.entity_degree(_links(spark, folder)[1], params.hub_degree_max)


@graph_query(
    "seed_entities",
    f"WITH {{TXN}}, {_KEPT} SELECT transaction_id AS seed_id, entity_type, entity_key FROM kept",
)
def seed_entities(spark, folder, params):
    txn, links = _links(spark, folder)
    return G.seed_entities(links, txn, params.hub_degree_max)


@graph_query(
    "window_neighbours",
    f"""WITH {{TXN}}, {_KEPT} SELECT q.transaction_id AS query_id, l.entity_type, l.entity_key, l.transaction_id, l.ts
FROM kept q JOIN kept l USING (entity_type, entity_key) WHERE l.ts >= q.ts - 86400 AND l.ts < q.ts""",
)
def window_neighbours(spark, folder, params):
    _, links = _links(spark, folder)
    queries = links.select(F.col("transaction_id").alias("query_id"), "entity_type", "entity_key", F.col("ts").alias("t"))
    day_before = G.ExpansionParams(back_s=86_400, fwd_s=0, hub_degree_max=params.hub_degree_max)
    return G.window_neighbours(links, queries, day_before)


@graph_query("expand", f"WITH {{TXN}}, {_EXPAND} SELECT * FROM members")
def expand(spark, folder, params):
    txn, links = _links(spark, folder)
    return G.expand(links, txn, params)


@graph_query(
    "expand_detailed",
    f"""WITH {{TXN}}, {_EXPAND}
SELECT seed_id, entity_type, entity_key, degree, false AS pruned, max(in_window) AS neighbors_in_window,
  sum((rn <= {{CAP}} AND member_id <> seed_id)::INT)::BIGINT AS retained_neighbors, max(in_window) > {{CAP}} AS cap_applied
FROM cand JOIN deg USING (entity_type, entity_key) GROUP BY ALL
UNION ALL SELECT transaction_id, entity_type, entity_key, degree, true, NULL, 0, false
FROM links JOIN deg USING (entity_type, entity_key) WHERE degree > {{HUB}}""",
)
def expand_detailed(spark, folder, params):
    txn, links = _links(spark, folder)
    return G.expand_detailed(links, txn, params)


_EDGES = """edges AS (SELECT m.seed_id, m.member_id, k.entity_type, k.entity_key
  FROM members m JOIN kept k ON k.transaction_id = m.member_id
  WHERE EXISTS (SELECT 1 FROM kept s WHERE s.transaction_id = m.seed_id AND s.entity_type = k.entity_type
    AND s.entity_key = k.entity_key))"""


@graph_query("incidence", f"WITH {{TXN}}, {_EXPAND}, {_EDGES} SELECT * FROM edges")
def incidence(spark, folder, params):
    txn, links = _links(spark, folder)
    members = G.expand(links, txn, params, G.held_entities(links, params), ["entities"])
    return G.incidence(links, members, txn, params).drop("member_ts")


@graph_query(
    "expansion_nodes",
    f"""WITH {{TXN}}, {_EXPAND}
SELECT seed_id, 'txn:' || member_id AS node_id, 'TRANSACTION' AS node_type, seed_id = member_id AS is_seed FROM members
UNION ALL SELECT transaction_id, entity_type || ':' || entity_key, entity_type, false FROM kept""",
)
def expansion_nodes(spark, folder, params):
    txn, links = _links(spark, folder)
    return G.expansion_graph(links, txn, params)[0]


@graph_query(
    "expansion_edges",
    f"""WITH {{TXN}}, {_EXPAND}, {_EDGES} SELECT seed_id, 'txn:' || member_id AS source,
  entity_type || ':' || entity_key AS target, 'HAS_ENTITY' AS relationship_type FROM edges""",
)
def expansion_edges(spark, folder, params):
    txn, links = _links(spark, folder)
    return G.expansion_graph(links, txn, params)[1]


_SUMMARY = """sizes AS (SELECT seed_id, count(*) AS transaction_count,
   ((max(member_ts) - min(member_ts)) * 2 + 36) // 72 / 100.0::DOUBLE AS time_span_hours,
   round(max(risk_score), 4) AS max_risk_score
  FROM members JOIN txn ON member_id = transaction_id GROUP BY 1),
ents AS (SELECT transaction_id AS seed_id, count(*) FILTER (degree <= {HUB}) AS entity_count,
   count(*) FILTER (degree <= {HUB} AND entity_type = 'CARD') AS card_count,
   count(*) FILTER (degree <= {HUB} AND entity_type = 'ADDRESS') AS address_count,
   count(*) FILTER (degree <= {HUB} AND entity_type = 'DEVICE') AS device_count,
   count(*) FILTER (degree > {HUB}) AS hub_pruned_count
  FROM links JOIN deg USING (entity_type, entity_key) GROUP BY 1),
summary AS (SELECT * FROM sizes JOIN ents USING (seed_id))"""


@graph_query("community_summary", f"WITH {{TXN}}, {_EXPAND}, {_SUMMARY} SELECT * FROM summary")
def community_summary(spark, folder, params):
    txn, links = _links(spark, folder)
    return G.community_summary(links, txn, txn, params)


@graph_query(
    "graph_context",
    f"""WITH {{TXN}}, {_EXPAND}, {_SUMMARY} SELECT summary.*, ts AS seed_ts, risk_score,
  ts - 14 * 86400 AS window_start, ts + 2 * 86400 AS window_end, 'v1' AS graph_version, substr(sha256(
  '{{"back_s": 1209600, "depth": 1, "fwd_s": 172800, "graph_version": "v1", "hub_degree_max": {{HUB}}, "neighbor_cap": {{CAP}}}}'
  ), 1, 16) AS params_hash FROM summary JOIN txn ON seed_id = transaction_id""",
)
def graph_context(spark, folder, params):
    txn, links = _links(spark, folder)
    return G.graph_context(links, txn, txn, params)


# -- components -------------------------------------------------------------------


def _tie_rows(spark, folder):
    """Accounts are cards per day; they are tied by a device used in the same hour."""
    txn = transactions(spark, folder).filter(F.col("device_key").isNotNull())
    day = day_of(F.col("ts"))
    return txn.select(
        "*",
        F.concat_ws("/", F.lpad(day.cast("string"), 3, "0"), F.lpad("card_key", 8, "0")).alias("account"),
        F.concat_ws("/", day, hour_of(F.col("ts")), "device_key").alias("device_hour"),
    )


_TIES = """rows_t AS (SELECT *, lpad((ts // 86400)::VARCHAR, 3, '0') || '/' || lpad(card_key, 8, '0') AS account,
   (ts // 86400) || '/' || ((ts % 86400) // 3600) || '/' || device_key AS device_hour
  FROM txn WHERE device_key IS NOT NULL),
e0 AS (SELECT DISTINCT account, device_hour AS tie_key FROM rows_t),
edges AS (SELECT account, tie_key FROM e0 WHERE tie_key IN (SELECT tie_key FROM e0 GROUP BY 1 HAVING count(*) > 1))"""

_COMPONENTS = f"""{_TIES},
reach(a, b) AS (SELECT DISTINCT account, account FROM edges
  UNION SELECT r.a, y.account FROM reach r JOIN edges x ON x.account = r.b JOIN edges y ON y.tie_key = x.tie_key),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
rings AS (SELECT DISTINCT 'ring' || (ts // 86400 % 5) AS ring, account AS node FROM rows_t WHERE is_fraud = 1)"""


@query("strong_ties", f"WITH {{TXN}}, {_TIES} SELECT account, 'device_hour' AS tie_type, tie_key FROM edges")
def strong_ties(spark, folder):
    return C.strong_ties(_tie_rows(spark, folder), "account", ["device_hour"])


def _components(spark, folder):
    rows = _tie_rows(spark, folder)
    ties = C.strong_ties(rows, "account", ["device_hour"]).select(
        "account", F.concat(F.lit("tie "), F.col("tie_key")).alias("tie")
    )
    found = C.connected_components(ties, "account", "tie").filter(~F.col("node").startswith("tie "))
    rings = rows.filter("is_fraud = 1").select(
        F.concat(F.lit("ring"), F.pmod(day_of(F.col("ts")), F.lit(5)).cast("string")).alias("ring"),
        F.col("account").alias("node"),
    ).distinct()
    return found, rings


@query("connected_components", f"WITH RECURSIVE {{TXN}}, {_COMPONENTS} SELECT * FROM comp")
def connected_components(spark, folder):
    return _components(spark, folder)[0]


_PURITY = f"""{_COMPONENTS},
cell AS (SELECT component, ring, count(*) AS n FROM comp LEFT JOIN rings USING (node) GROUP BY ALL),
purity AS (SELECT component, sum(n)::BIGINT AS size, coalesce(sum(n) FILTER (ring IS NOT NULL), 0)::BIGINT AS ring_members,
   round(coalesce(sum(n) FILTER (ring IS NOT NULL), 0) / sum(n), 3) AS purity,
   coalesce((SELECT ring FROM cell c WHERE c.component = cell.component AND ring IS NOT NULL ORDER BY n DESC, ring LIMIT 1), '-')
     AS dominant_ring
  FROM cell GROUP BY component HAVING sum(n) >= 3)"""


@query("component_purity", f"WITH RECURSIVE {{TXN}}, {_PURITY} SELECT * FROM purity")
def component_purity(spark, folder):
    return C.component_purity(*_components(spark, folder))


@query(
    "ring_recovery",
    f"""WITH RECURSIVE {{TXN}}, {_PURITY}, best AS (SELECT *, row_number() OVER (PARTITION BY dominant_ring
   ORDER BY ring_members DESC, component) AS rn FROM purity)
SELECT ring, coalesce(purity >= 0.5, false) AS recovered, purity AS best_purity
FROM (SELECT DISTINCT ring FROM rings) LEFT JOIN (SELECT * FROM best WHERE rn = 1) ON dominant_ring = ring""",
)
def ring_recovery(spark, folder):
    found, rings = _components(spark, folder)
    return C.ring_recovery(C.component_purity(found, rings), rings)


# -- evidence -----------------------------------------------------------------------


def _featured(spark, folder):
    txn = transactions(spark, folder)
    return txn.join(H.relational_features(txn), "transaction_id", "left")


_FEATURES = _history_sql(_STRICT, 2).replace("WITH {TXN}, w AS", "w AS")
_HEAD, _TAIL = _FEATURES.split("\nSELECT transaction_id,", 1)
_ROWS = f"""{_HEAD}, r AS (SELECT transaction_id,{_TAIL}),
rows_f AS (SELECT txn.*, r.* EXCLUDE (transaction_id) FROM txn JOIN r USING (transaction_id))"""


def _dec(x: str, digits: int) -> str:
    return f"CAST(CAST(round({x}, {digits}) AS DECIMAL(18,{digits})) AS VARCHAR)"


_COLUMNS = "transaction_id, evidence_type, severity, title, description, details"

_AMOUNT = f"""amount_hits AS (
  SELECT *, 'card' AS entity, card_key AS k, amt_z_card AS z FROM rows_f WHERE abs(amt_z_card) >= 2
  UNION ALL SELECT *, 'device', device_key, amt_z_device FROM rows_f WHERE abs(amt_z_device) >= 2),
amount_ev AS (SELECT transaction_id, 'AMOUNT_DEVIATION' AS evidence_type,
  CASE WHEN abs(z) >= 3 THEN 'high' ELSE 'medium' END AS severity, 'Amount deviation for ' || entity AS title,
  'Amount ' || {_dec('amount', 2)} || ' lies ' || CASE WHEN z >= 0 THEN '+' ELSE '' END || {_dec('z', 1)}
   || ' deviations from the mean of ' || entity || ' ' || k AS description,
  '{{"current_amount":' || {_dec('amount', 2)} || ',"metric":"welford_z","reference_entity":"' || entity || ':' || k
   || '","threshold":2.00,"z_score":' || {_dec('z', 3)} || '}}' AS details,
  '{{"code_version":"v1","source_row_ids":[' || transaction_id || '],"source_table":"production_features"}}' AS provenance
  FROM amount_hits)"""


def _only(records, *extra):
    return records.select(*E.RECORD[:6], *extra)


@query("ev_amount_deviation", f"WITH {{TXN}}, {_ROWS}, {_AMOUNT} SELECT {_COLUMNS} FROM amount_ev")
def ev_amount_deviation(spark, folder):
    return _only(E.ev_amount_deviation(_featured(spark, folder)))


_HOUR = f"""hour_hits AS (
  SELECT *, 'card' AS entity, card_key AS k, hour_dev_card AS d FROM rows_f WHERE hour_dev_card >= 0.35
  UNION ALL SELECT *, 'device', device_key, hour_dev_device FROM rows_f WHERE hour_dev_device >= 0.35),
hour_ev AS (SELECT transaction_id, 'UNUSUAL_HOUR' AS evidence_type, 'low' AS severity, 'Unusual hour for ' || entity AS title,
  'Hour ' || ((ts % 86400) // 3600) || ' is ' || {_dec('d', 2)} || ' (0-1) from the usual hour of ' || entity || ' ' || k AS description,
  '{{"hour_dev":' || {_dec('d', 3)} || ',"metric":"circular_hour_distance","reference_entity":"' || entity || ':' || k
   || '","threshold":0.35,"transaction_hour":' || ((ts % 86400) // 3600) || '}}' AS details FROM hour_hits)"""


@query("ev_unusual_hour", f"WITH {{TXN}}, {_ROWS}, {_HOUR} SELECT {_COLUMNS} FROM hour_ev")
def ev_unusual_hour(spark, folder):
    return _only(E.ev_unusual_hour(_featured(spark, folder)))


_PAIRING = f"""pair_hits AS (
  SELECT *, 'device_card' AS pair_type, 'device' AS other, device_key AS k, 'medium' AS severity FROM rows_f
   WHERE is_new_device_card_pair = 1
  UNION ALL SELECT *, 'addr_card', 'address', addr_key, 'low' FROM rows_f WHERE is_new_addr_card_pair = 1),
pair_ev AS (SELECT transaction_id, 'NEW_PAIRING' AS evidence_type, severity, 'New ' || other || '-card pairing' AS title,
  'Card ' || card_key || ' was never seen with ' || other || ' ' || k || ' before' AS description,
  CASE other WHEN 'device' THEN '{{"card":"' || card_key || '","device":"' || k || '","pair_type":"device_card","prior_count":0}}'
   ELSE '{{"address":"' || k || '","card":"' || card_key || '","pair_type":"addr_card","prior_count":0}}' END AS details FROM pair_hits)"""


@query("ev_new_pairing", f"WITH {{TXN}}, {_ROWS}, {_PAIRING} SELECT {_COLUMNS} FROM pair_ev")
def ev_new_pairing(spark, folder):
    return _only(E.ev_new_pairing(_featured(spark, folder)))


def _burst(column: str, kind: str, key: str, window: str, least: int) -> str:
    return (
        f"SELECT transaction_id, '{kind}' AS t, {key} AS k, '{window}' AS win, {column}::BIGINT AS n, {least} AS least"
        f" FROM rows_f WHERE {column} >= {least}"
    )


_BURSTS = f"""{_burst("card_tx_1h", "CARD", "card_key", "1h", 3)} UNION ALL {_burst("card_tx_24h", "CARD", "card_key", "24h", 8)}
 UNION ALL {_burst("dev_tx_1h", "DEVICE", "device_key", "1h", 3)} UNION ALL {_burst("dev_tx_24h", "DEVICE", "device_key", "24h", 8)}"""


_VELOCITY = f"""burst AS ({_BURSTS}),
burst_ev AS (SELECT transaction_id, 'VELOCITY_BURST' AS evidence_type, 'medium' AS severity, 'Velocity burst for ' || t || ' ' || k AS title,
  t || ' ' || k || ' has ' || n || ' transactions in the last ' || win || ' (threshold ' || least || ')' AS description,
  '{{"count":' || n || ',"entity":"' || t || ':' || k || '","threshold":' || least || ',"window":"' || win || '"}}' AS details
 FROM burst JOIN deg ON entity_type = t AND entity_key = k WHERE degree <= {{HUB}})"""


@graph_query("ev_velocity_burst", f"WITH {{TXN}}, {_LINKS}, {_ROWS}, {_VELOCITY} SELECT {_COLUMNS} FROM burst_ev")
def ev_velocity_burst(spark, folder, params):
    _, links = _links(spark, folder)
    hubs = G.entity_degree(links, params.hub_degree_max).filter("is_hub").select("entity_type", "entity_key")
    return _only(E.ev_velocity_burst(_featured(spark, folder), hubs))


_SHARED = """u AS (SELECT m.seed_id, k.entity_key AS dev, list(m.member_id ORDER BY m.member_id)
    FILTER (m.member_id <> m.seed_id) AS ids
  FROM members m JOIN kept k ON k.transaction_id = m.member_id AND k.entity_type = 'DEVICE'
  JOIN kept s ON s.transaction_id = m.seed_id AND s.entity_type = 'DEVICE' AND s.entity_key = k.entity_key GROUP BY 1, 2),
shared_ev AS (SELECT seed_id AS transaction_id, 'SHARED_DEVICE_LINK' AS evidence_type, 'medium' AS severity, 'Shared device ' || dev AS title,
  'Device ' || dev || ' links ' || len(ids) || ' other transactions' AS description,
  '{"connected_transaction_ids":[' || array_to_string(ids[1:10], ',') || '],"count":' || len(ids) || ',"device":"' || dev
   || '","window":"-14d/+2d"}' AS details, ids FROM u WHERE len(ids) >= 2)"""


@graph_query("ev_shared_device", f"WITH {{TXN}}, {_EXPAND}, {_SHARED} SELECT {_COLUMNS} FROM shared_ev")
def ev_shared_device(spark, folder, params):
    txn, links = _links(spark, folder)
    return _only(E.ev_shared_device(links, G.expand(links, txn, params), txn, params))


_COMMUNITY = f"""{_SUMMARY},
community_ev AS (SELECT seed_id AS transaction_id, 'COMMUNITY_STATS' AS evidence_type, 'info' AS severity, 'Investigation community' AS title,
  'Community of ' || transaction_count || ' transactions and ' || entity_count || ' entities over ' || {_dec('time_span_hours', 2)}
   || ' hours' AS description,
  '{{"address_count":' || address_count || ',"card_count":' || card_count || ',"device_count":' || device_count
   || ',"entity_count":' || entity_count || ',"hub_pruned_count":' || hub_pruned_count || ',"max_risk_score":'
   || {_dec('max_risk_score', 4)} || ',"time_span_hours":' || {_dec('time_span_hours', 2)} || ',"transaction_count":'
   || transaction_count || '}}' AS details
FROM summary WHERE transaction_count >= 3)"""


@graph_query("ev_community", f"WITH {{TXN}}, {_EXPAND}, {_COMMUNITY} SELECT {_COLUMNS} FROM community_ev")
def ev_community(spark, folder, params):
    txn, links = _links(spark, folder)
    members = G.expand(links, txn, params, G.held_scores(txn))
    return _only(E.ev_community(G.community_summary(links, txn, txn, params, members, ids=True), members))


_BAND = """CASE WHEN risk_score >= 0.85 THEN 'CRITICAL' WHEN risk_score >= 0.6 THEN 'HIGH'
 WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"""


_CONNECTED = f"""connected_ev AS (SELECT seed_id AS transaction_id, 'CONNECTED_HIGH_RISK' AS evidence_type, 'high' AS severity,
  'Connected high-risk transaction ' || member_id AS title,
  'Connected transaction ' || member_id || ' has risk ' || {_dec('risk_score + 1e-9', 3)} || ' (' || {_BAND} || ')' AS description,
  '{{"connected_transaction_id":' || member_id || ',"risk_band":"' || {_BAND} || '","risk_score":'
   || {_dec('risk_score + 1e-9', 4)} || ',"threshold":0.60}}' AS details, member_id
 FROM members JOIN txn ON member_id = transaction_id WHERE member_id <> seed_id AND risk_score >= 0.6)"""


def _shifted(txn):
    """Scores moved off exact ties at four digits, with the band they have unmoved."""
    return txn.select("transaction_id", (F.col("risk_score") + 1e-9).alias("risk_score"), risk_band(F.col("risk_score")).alias("risk_band"))


@graph_query("ev_connected_high_risk", f"WITH {{TXN}}, {_EXPAND}, {_CONNECTED} SELECT {_COLUMNS} FROM connected_ev")
def ev_connected_high_risk(spark, folder, params):
    txn, links = _links(spark, folder)
    scores = _shifted(txn).filter(F.col("risk_score") - 1e-9 >= E.CONNECTED_SCORE_MIN)
    members = G.expand(links, txn, params, G.held_scores(scores))
    return _only(E.ev_connected_high_risk(members, scores))


_QUIET = """fired AS (
  SELECT transaction_id FROM rows_f WHERE abs(amt_z_card) >= 2 OR abs(amt_z_device) >= 2 OR hour_dev_card >= 0.35
    OR hour_dev_device >= 0.35 OR is_new_device_card_pair = 1 OR is_new_addr_card_pair = 1
  UNION SELECT transaction_id FROM burst_ev
  -- two other members with the seed's device are also a community of three
  UNION SELECT seed_id FROM members GROUP BY 1 HAVING count(*) >= 3
  UNION SELECT seed_id FROM members JOIN txn ON member_id = transaction_id WHERE member_id <> seed_id AND risk_score >= 0.6),
quiet_ev AS (SELECT transaction_id, 'NO_RELATIONAL_EVIDENCE' AS evidence_type, 'info' AS severity, 'No qualifying relational evidence' AS title,
  'None of the checked rules fired for this transaction' AS description,
  '{"checked_types":["NEW_PAIRING","AMOUNT_DEVIATION","UNUSUAL_HOUR","VELOCITY_BURST","SHARED_DEVICE_LINK","COMMUNITY_STATS",'
   || '"CONNECTED_HIGH_RISK"],"window":"-14d/+2d"}' AS details FROM txn WHERE transaction_id NOT IN (SELECT transaction_id FROM fired))"""


@graph_query("ev_none", f"WITH {{TXN}}, {_EXPAND}, {_ROWS}, {_VELOCITY}, {_QUIET} SELECT {_COLUMNS} FROM quiet_ev")
def ev_none(spark, folder, params):
    """What the other seven rules leave."""
    txn, links = _links(spark, folder)
    made = E.generate_evidence(_featured(spark, folder), links, txn, params)
    return _only(E.ev_none(txn, made.filter(F.col("evidence_type") != E.NO_EVIDENCE), params))


def _final(rows):
    """Ids and hashes of the records of the CTE ``rows``."""
    return f"""seeded AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('{{"description":"' || description || '","details":' || details
   || ',"evidence_type":"' || evidence_type || '","provenance":' || provenance || ',"severity":"' || severity
   || '","title":"' || title || '","transaction_id":' || transaction_id || '}}')) AS d FROM {rows}),
ided AS (SELECT *, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-'
   || substr('89ab', ('0x' || substr(d, 17, 1))::INT % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS evidence_id FROM seeded),
final AS (SELECT {_COLUMNS}, provenance, evidence_id, sha256('{{"description":"' || description || '","details":' || details
   || ',"evidence_id":"' || evidence_id || '","evidence_type":"' || evidence_type || '","provenance":' || provenance
   || ',"severity":"' || severity || '","title":"' || title || '","transaction_id":' || transaction_id || '}}') AS evidence_hash
  FROM ided)"""


@query("finalize_evidence", f"WITH {{TXN}}, {_ROWS}, {_AMOUNT}, {_final('amount_ev')} SELECT * FROM final")
def finalize_evidence(spark, folder):
    return E.finalize(E.ev_amount_deviation(_featured(spark, folder)))


@query(
    "verify_evidence",
    f"WITH {{TXN}}, {_ROWS}, {_AMOUNT}, {_final('amount_ev')} SELECT evidence_id, evidence_hash FROM final WHERE severity = 'high'",
)
def verify_evidence(spark, folder):
    """Records of high severity are altered after hashing; exactly those are found."""
    stored = E.finalize(E.ev_amount_deviation(_featured(spark, folder)))
    altered = stored.withColumn(
        "severity", F.when(F.col("severity") == "high", "none").otherwise(F.col("severity"))
    )
    return E.verify_evidence(altered).select("evidence_id", "evidence_hash")


@query(
    "evidence_counts",
    f"""WITH {{TXN}}, {_ROWS}, {_AMOUNT} SELECT transaction_id, evidence_type, count(*) AS records FROM amount_ev GROUP BY ALL""",
)
def evidence_counts(spark, folder):
    return E.evidence_counts(E.ev_amount_deviation(_featured(spark, folder)))


_OWN = "[transaction_id]"
_ALL = f"""spread AS (SELECT seed_id, list_sort(list(member_id)) AS ids FROM members GROUP BY 1), every AS (
  SELECT {_COLUMNS}, 'production_features' AS source, {_OWN} AS ids FROM amount_ev
  UNION ALL SELECT {_COLUMNS}, 'production_features', {_OWN} FROM hour_ev
  UNION ALL SELECT {_COLUMNS}, 'graph_links', {_OWN} FROM pair_ev
  UNION ALL SELECT {_COLUMNS}, 'graph_links', {_OWN} FROM burst_ev
  UNION ALL SELECT {_COLUMNS}, 'graph_links', list_sort(list_append(ids, transaction_id)) FROM shared_ev
  UNION ALL SELECT {_COLUMNS}, 'graph_links', ids FROM community_ev JOIN spread ON seed_id = transaction_id
  UNION ALL SELECT {_COLUMNS}, 'risk_predictions', list_sort([member_id, transaction_id]) FROM connected_ev
  UNION ALL SELECT {_COLUMNS}, 'graph_links', {_OWN} FROM quiet_ev),
proven AS (SELECT {_COLUMNS}, '{{"code_version":"v1","source_row_ids":[' || array_to_string(ids, ',') || '],"source_table":"'
   || source || '"}}' AS provenance FROM every)"""


@graph_query(
    "generate_evidence",
    f"""WITH {{TXN}}, {_EXPAND}, {_ROWS}, {_AMOUNT}, {_HOUR}, {_PAIRING}, {_VELOCITY}, {_SHARED}, {_COMMUNITY}, {_CONNECTED},
{_QUIET}, {_ALL}, {_final("proven")} SELECT * FROM final""",
)
def generate_evidence(spark, folder, params):
    """All eight rules for all transactions; ids and hashes included."""
    txn, links = _links(spark, folder)
    return E.generate_evidence(_featured(spark, folder), links, _shifted(txn), params)
