"""Rule-based evidence for all transactions at once.

A rule returns records (transaction_id, evidence_type, severity, title, description,
details, source_table, source_row_ids); ``finalize`` adds provenance, id and hash.
Numbers inside texts are rounded decimals, so the texts do not depend on how a
double is printed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.canonical import canonical_json, content_hash, name_uuid, nested_json
from ledgerlens.functions.scalars import hour_of, risk_band
from ledgerlens.operators.graph import (
    ExpansionParams,
    community_summary,
    entity_degree,
    expand,
    held_scores,
    without_hubs,
)
from ledgerlens.operators.history import RELATIONAL_FEATURES
from ledgerlens.operators.review import latest_scores
from ledgerlens.operators.spread import spread_join
from ledgerlens.session import cut_lineage

KEYS = ("card_key", "device_key", "addr_key")

# Rule thresholds and the version written into the provenance.
AMOUNT_Z_MIN = 2.0
AMOUNT_Z_HIGH = 3.0
HOUR_DEV_MIN = 0.35
VELOCITY_MIN = {"card_tx_1h": 3, "card_tx_24h": 8, "dev_tx_1h": 3, "dev_tx_24h": 8}
SHARED_DEVICE_MIN = 2
SHARED_DEVICE_LISTED = 10
COMMUNITY_MIN = 3
CONNECTED_SCORE_MIN = 0.6
ENGINE_VERSION = "v1"
NO_EVIDENCE = "NO_RELATIONAL_EVIDENCE"
CHECKED = (
    "NEW_PAIRING",
    "AMOUNT_DEVIATION",
    "UNUSUAL_HOUR",
    "VELOCITY_BURST",
    "SHARED_DEVICE_LINK",
    "COMMUNITY_STATS",
    "CONNECTED_HIGH_RISK",
)

RECORD = (
    "transaction_id",
    "evidence_type",
    "severity",
    "title",
    "description",
    "details",
    "source_table",
    "source_row_ids",
)


def _dec(value: Column, digits: int) -> Column:
    """Rounded decimal; the first rounding removes noise in the last digits of a double."""
    return F.round(F.round(value, 6), digits).cast(f"decimal(20,{digits})")


def _text(value: Column, digits: int) -> Column:
    return _dec(value, digits).cast("string")


def _record(
    df: DataFrame,
    evidence_type: str,
    severity: Column,
    title: Column,
    description: Column,
    details: Mapping[str, Column] | Column,
    source_table: str,
    source_row_ids: Column,
) -> DataFrame:
    return df.select(
        "transaction_id",
        F.lit(evidence_type).alias("evidence_type"),
        severity.alias("severity"),
        title.alias("title"),
        description.alias("description"),
        (details if isinstance(details, Column) else canonical_json(details)).alias("details"),
        F.lit(source_table).alias("source_table"),
        F.array_sort(F.array_distinct(source_row_ids)).alias("source_row_ids"),
    )


def _own_id() -> Column:
    return F.array(F.col("transaction_id"))


def _per_entity(rows: DataFrame, entries: Sequence[tuple[str, str, str]], value: str) -> DataFrame:
    """One row per (entity, key column, value column) entry whose value is present."""
    structs = [
        F.struct(F.lit(entity).alias("entity"), F.col(key).alias("entity_key"), F.col(col).alias(value))
        for entity, key, col in entries
    ]
    return rows.select("*", F.inline(F.array(*structs))).filter(F.col(value).isNotNull())


def ev_amount_deviation(rows: DataFrame, z_min: float = AMOUNT_Z_MIN) -> DataFrame:
    """``rows``: transactions with their keys and relational features."""
    z = F.col("z")
    hits = _per_entity(
        rows, (("card", "card_key", "amt_z_card"), ("device", "device_key", "amt_z_device")), "z"
    ).filter(F.abs(z) >= z_min)
    sign = F.when(z >= 0, F.lit("+")).otherwise(F.lit(""))
    return _record(
        hits,
        "AMOUNT_DEVIATION",
        F.when(F.abs(z) >= AMOUNT_Z_HIGH, "high").otherwise("medium"),
        F.concat(F.lit("Amount deviation for "), F.col("entity")),
        F.concat(
            F.lit("Amount "), _text(F.col("amount"), 2), F.lit(" lies "), sign, _text(z, 1),
            F.lit(" deviations from the mean of "), F.col("entity"), F.lit(" "), F.col("entity_key"),
        ),
        {
            "reference_entity": F.concat_ws(":", "entity", "entity_key"),
            "z_score": _dec(z, 3),
            "current_amount": _dec(F.col("amount"), 2),
            "threshold": _dec(F.lit(z_min), 2),
            "metric": F.lit("welford_z"),
        },
        "production_features",
        _own_id(),
    )


def ev_unusual_hour(rows: DataFrame, dev_min: float = HOUR_DEV_MIN) -> DataFrame:
    hits = _per_entity(
        rows, (("card", "card_key", "hour_dev_card"), ("device", "device_key", "hour_dev_device")), "dev"
    ).filter(F.col("dev") >= dev_min)
    hour = hour_of(F.col("ts"))
    return _record(
        hits,
        "UNUSUAL_HOUR",
        F.lit("low"),
        F.concat(F.lit("Unusual hour for "), F.col("entity")),
        F.concat(
            F.lit("Hour "), hour.cast("string"), F.lit(" is "), _text(F.col("dev"), 2),
            F.lit(" (0-1) from the usual hour of "), F.col("entity"), F.lit(" "), F.col("entity_key"),
        ),
        {
            "reference_entity": F.concat_ws(":", "entity", "entity_key"),
            "hour_dev": _dec(F.col("dev"), 3),
            "transaction_hour": hour,
            "threshold": _dec(F.lit(dev_min), 2),
            "metric": F.lit("circular_hour_distance"),
        },
        "production_features",
        _own_id(),
    )


def ev_new_pairing(rows: DataFrame) -> DataFrame:
    entries = F.array(
        F.struct(
            F.lit("device_card").alias("pair_type"), F.lit("device").alias("other"),
            F.col("device_key").alias("other_key"), F.col("is_new_device_card_pair").alias("is_new"),
        ),
        F.struct(
            F.lit("addr_card").alias("pair_type"), F.lit("address").alias("other"),
            F.col("addr_key").alias("other_key"), F.col("is_new_addr_card_pair").alias("is_new"),
        ),
    )
    hits = rows.select("*", F.inline(entries)).filter(F.col("is_new") == 1.0)

    def details(other: str) -> Column:
        return canonical_json(
            {
                "pair_type": F.col("pair_type"),
                other: F.col("other_key"),
                "card": F.col("card_key"),
                "prior_count": F.lit(0),
            }
        )

    return _record(
        hits,
        "NEW_PAIRING",
        F.when(F.col("other") == "device", "medium").otherwise("low"),
        F.concat(F.lit("New "), F.col("other"), F.lit("-card pairing")),
        F.concat(
            F.lit("Card "), F.col("card_key"), F.lit(" was never seen with "), F.col("other"),
            F.lit(" "), F.col("other_key"), F.lit(" before"),
        ),
        F.when(F.col("other") == "device", details("device")).otherwise(details("address")),
        "graph_links",
        _own_id(),
    )


def ev_velocity_burst(
    rows: DataFrame, hubs: DataFrame, thresholds: Mapping[str, int] = VELOCITY_MIN
) -> DataFrame:
    """``hubs``: (entity_type, entity_key) of entities that are never reported."""
    entries = []
    for column, threshold in thresholds.items():
        kind = "CARD" if column.startswith("card") else "DEVICE"
        entries.append(
            F.struct(
                F.lit(kind).alias("entity_type"),
                F.col("card_key" if kind == "CARD" else "device_key").alias("entity_key"),
                F.lit(column.rsplit("_", 1)[1]).alias("window"),
                F.col(column).alias("n"),
                F.lit(threshold).alias("threshold"),
            )
        )
    hits = (
        rows.select("transaction_id", F.inline(F.array(*entries)))
        .filter(F.col("n") >= F.col("threshold"))
    )
    # Busy entities are the ones that fire, so the join to the hubs is spread.
    hits = spread_join(hits, hubs, ["entity_type", "entity_key"], "left_anti", by=["transaction_id"])
    name = F.concat_ws(" ", "entity_type", "entity_key")
    count = F.col("n").cast("long")
    return _record(
        hits,
        "VELOCITY_BURST",
        F.lit("medium"),
        F.concat(F.lit("Velocity burst for "), name),
        F.concat(
            name, F.lit(" has "), count.cast("string"), F.lit(" transactions in the last "),
            F.col("window"), F.lit(" (threshold "), F.col("threshold").cast("string"), F.lit(")"),
        ),
        {
            "entity": F.concat_ws(":", "entity_type", "entity_key"),
            "window": F.col("window"),
            "count": count,
            "threshold": F.col("threshold"),
        },
        "graph_links",
        _own_id(),
    )


def _devices(links: DataFrame, params: ExpansionParams) -> DataFrame:
    return without_hubs(links.filter("entity_type = 'DEVICE'"), params.hub_degree_max).select(
        "transaction_id", "entity_key"
    )


def ev_shared_device(
    links: DataFrame, members: DataFrame, seeds: DataFrame, params: ExpansionParams = ExpansionParams()
) -> DataFrame:
    """The seed's device is used by at least two other members of its neighbourhood.

    Members may carry their non-hub ``devices`` and those of their seed (``seed_devices``).
    """
    if {"devices", "seed_devices"} <= set(members.columns):
        shared = F.array_intersect("devices", "seed_devices")
        using = members.select("seed_id", "member_id", F.explode(shared).alias("entity_key"))
    else:
        devices = _devices(links, params)
        of_seed = devices.join(seeds.select("transaction_id"), "transaction_id", "left_semi").select(
            F.col("transaction_id").alias("seed_id"), "entity_key"
        )
        using = members.join(
            devices.select(F.col("transaction_id").alias("member_id"), "entity_key"), "member_id", "inner"
        ).join(of_seed, ["seed_id", "entity_key"], "left_semi")
    # A neighbourhood is bounded by the cap per entity, so these lists are short.
    grouped = using.groupBy(F.col("seed_id").alias("transaction_id"), "entity_key").agg(
        F.array_sort(F.collect_set("member_id")).alias("linked")
    )
    others = F.array_remove(F.col("linked"), F.col("transaction_id"))
    hits = grouped.withColumn("others", others).filter(F.size("others") >= SHARED_DEVICE_MIN)
    count = F.size("others").cast("long")
    return _record(
        hits,
        "SHARED_DEVICE_LINK",
        F.lit("medium"),
        F.concat(F.lit("Shared device "), F.col("entity_key")),
        F.concat(
            F.lit("Device "), F.col("entity_key"), F.lit(" links "), count.cast("string"), F.lit(" other transactions")
        ),
        {
            "device": F.col("entity_key"),
            "connected_transaction_ids": F.slice("others", 1, SHARED_DEVICE_LISTED),
            "count": count,
            "window": F.lit(_window_text(params)),
        },
        "graph_links",
        F.col("linked"),
    )


def _window_text(params: ExpansionParams) -> str:
    return f"-{params.back_s // 86_400}d/+{params.fwd_s // 86_400}d"


def ev_community(summary: DataFrame, members: DataFrame) -> DataFrame:
    """``summary`` comes from ``community_summary``, ``members`` from ``expand``.

    A summary with ``ids`` has them from the same members, which then need not be made again.
    """
    large = summary.filter(F.col("transaction_count") >= COMMUNITY_MIN)
    if "ids" in summary.columns:
        hits = large.filter(F.col("seed_id").isNotNull())
    else:
        hits = large.join(members.groupBy("seed_id").agg(F.collect_set("member_id").alias("ids")), "seed_id", "inner")
    hits = hits.withColumnRenamed("seed_id", "transaction_id")
    names = (
        "transaction_count", "entity_count", "card_count", "address_count", "device_count", "hub_pruned_count",
    )
    return _record(
        hits,
        "COMMUNITY_STATS",
        F.lit("info"),
        F.lit("Investigation community"),
        F.concat(
            F.lit("Community of "), F.col("transaction_count").cast("string"), F.lit(" transactions and "),
            F.col("entity_count").cast("string"), F.lit(" entities over "),
            _text(F.col("time_span_hours"), 2), F.lit(" hours"),
        ),
        {
            **{n: F.col(n) for n in names},
            "time_span_hours": _dec(F.col("time_span_hours"), 2),
            "max_risk_score": _dec(F.col("max_risk_score"), 4),
        },
        "graph_links",
        F.col("ids"),
    )


def ev_connected_high_risk(members: DataFrame, scores: DataFrame) -> DataFrame:
    """One record per other member with a high score. Members may carry their ``scores``."""
    high = F.col("risk_score") >= CONNECTED_SCORE_MIN
    band = F.col("risk_band") if "risk_band" in scores.columns else risk_band(F.col("risk_score"))
    others = members.filter("member_id <> seed_id")
    if "scores" in members.columns:
        told = others.select("seed_id", "member_id", F.inline("scores")).filter(high)
        hits = told.select(F.col("seed_id").alias("transaction_id"), "member_id", "risk_score", band.alias("band"))
    else:
        risky = scores.filter(high).select(F.col("transaction_id").alias("member_id"), "risk_score", band.alias("band"))
        hits = others.join(risky, "member_id", "inner").withColumnRenamed("seed_id", "transaction_id")
    member = F.col("member_id").cast("string")
    return _record(
        hits,
        "CONNECTED_HIGH_RISK",
        F.lit("high"),
        F.concat(F.lit("Connected high-risk transaction "), member),
        F.concat(
            F.lit("Connected transaction "), member, F.lit(" has risk "), _text(F.col("risk_score"), 3),
            F.lit(" ("), F.col("band"), F.lit(")"),
        ),
        {
            "connected_transaction_id": F.col("member_id"),
            "risk_score": _dec(F.col("risk_score"), 4),
            "risk_band": F.col("band"),
            "threshold": _dec(F.lit(CONNECTED_SCORE_MIN), 2),
        },
        "risk_predictions",
        F.array("member_id", "transaction_id"),
    )


def ev_none(seeds: DataFrame, fired: DataFrame, params: ExpansionParams = ExpansionParams()) -> DataFrame:
    """A record for each seed without any record in ``fired``, the output of the seven other rules."""
    quiet = seeds.select("transaction_id").join(fired.select("transaction_id"), "transaction_id", "left_anti")
    return _quiet(quiet, params)


def _quiet(seeds: DataFrame, params: ExpansionParams) -> DataFrame:
    return _record(
        seeds,
        NO_EVIDENCE,
        F.lit("info"),
        F.lit("No qualifying relational evidence"),
        F.lit("None of the checked rules fired for this transaction"),
        {"checked_types": F.array(*[F.lit(t) for t in CHECKED]), "window": F.lit(_window_text(params))},
        "graph_links",
        _own_id(),
    )


def finalize(records: DataFrame, version: str = ENGINE_VERSION) -> DataFrame:
    """Records with provenance, name-based id and content hash."""
    provenance = canonical_json(
        {
            "source_table": F.col("source_table"),
            "source_row_ids": F.col("source_row_ids"),
            "code_version": F.lit(version),
        }
    )
    made = records.select(*RECORD[:6], provenance.alias("provenance"))
    plain = {
        n: F.col(n) for n in ("transaction_id", "evidence_type", "severity", "title", "description")
    }
    embedded = {"details": F.col("details"), "provenance": F.col("provenance")}
    with_id = made.withColumn("evidence_id", name_uuid(nested_json(plain, embedded)))
    return with_id.withColumn("evidence_hash", _hash())


def _hash() -> Column:
    plain = {
        n: F.col(n)
        for n in ("evidence_id", "transaction_id", "evidence_type", "severity", "title", "description")
    }
    return content_hash(
        nested_json(plain, {"details": F.col("details"), "provenance": F.col("provenance")})
    )


def verify_evidence(evidence: DataFrame) -> DataFrame:
    """Stored records whose content does not match their hash."""
    return evidence.withColumn("recomputed_hash", _hash()).filter(
        ~F.col("evidence_hash").eqNullSafe(F.col("recomputed_hash"))
    )


def _about(links: DataFrame, scores: DataFrame, params: ExpansionParams) -> DataFrame:
    """What rules ask of a member: its scores and its non-hub devices, as two lists per transaction."""
    held = held_scores(scores)
    entry = held.schema["scores"].dataType.elementType
    both = held.select("transaction_id", F.explode("scores").alias("score"), F.lit(None).cast("string").alias("device")).unionByName(
        _devices(links, params).filter(F.col("transaction_id").isNotNull())
        .select("transaction_id", F.lit(None).cast(entry).alias("score"), F.col("entity_key").alias("device"))
    )
    return both.groupBy("transaction_id").agg(
        F.collect_list("score").alias("scores"), F.collect_list("device").alias("devices")
    )


def generate_evidence(
    rows: DataFrame,
    links: DataFrame,
    scores: DataFrame,
    params: ExpansionParams = ExpansionParams(),
) -> DataFrame:
    """All evidence of all transactions in ``rows`` (keys, amount, ts, relational features).

    Features and neighbourhoods feed several rules, so the features and the lists per entity from
    which each rule makes its members are written to the checkpoint folder. Scores of several versions need ``scored_at``: the
    latest of each transaction counts.
    """
    if {"model_version", "scored_at"} <= set(scores.columns):
        scores = latest_scores(scores)
    elif "model_version" in scores.columns:
        raise ValueError("scores of several versions need scored_at; else select one version and drop model_version")
    rows = cut_lineage(rows.select("transaction_id", "ts", "amount", *KEYS, *RELATIONAL_FEATURES))
    seeds = rows.select("transaction_id", "ts")
    members = expand(links, seeds, params, _about(links, scores, params), ["devices"], settle=True)
    summary = community_summary(links, seeds, scores, params, members, ids=True)
    hubs = entity_degree(links, params.hub_degree_max).filter("is_hub").select("entity_type", "entity_key")
    records = reduce(
        DataFrame.unionByName,
        (
            ev_amount_deviation(rows),
            ev_unusual_hour(rows),
            ev_new_pairing(rows),
            ev_velocity_burst(rows, hubs),
            ev_shared_device(links, members, seeds, params),
            ev_community(summary, members),
            ev_connected_high_risk(members, scores),
            _quiet(seeds, params),
        ),
    )
    # A transaction has few records: its neighbourhood is bounded by the cap per entity.
    alone = F.count("*").over(Window.partitionBy("transaction_id")) == 1
    kept = records.withColumn("_alone", alone).filter(F.col("_alone") | (F.col("evidence_type") != NO_EVIDENCE))
    return finalize(kept.drop("_alone"))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("transaction_id", "evidence_type").agg(F.count("*").alias("records"))
