"""Links between transactions and entities, and the neighbourhood of a transaction."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import DAY_S
from ledgerlens.operators.history import ADDRESS, CARD, DEVICE, TxnColumns
from ledgerlens.operators.spread import HOT_ROWS, spread_join
from ledgerlens.session import cut_lineage

# The key comes first: sorts then rarely compare more than its first bytes.
ENTITY = ["entity_key", "entity_type"]


@dataclass(frozen=True)
class ExpansionParams:
    """How far an expansion reaches. Only direct neighbours (depth 1) exist."""

    back_s: int = 14 * DAY_S
    fwd_s: int = 2 * DAY_S
    hub_degree_max: int = 1000
    neighbor_cap: int = 200
    depth: int = 1
    graph_version: str = "v1"

    def __post_init__(self) -> None:
        if self.depth != 1:
            raise ValueError("only depth 1 is supported")

    def digest(self) -> str:
        """Short hash that names a set of parameters."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def build_links(txn: DataFrame, cols: TxnColumns = TxnColumns()) -> DataFrame:
    """One row per transaction and card, address or device, from one pass over the input."""
    roles = ((CARD, cols.card), (ADDRESS, cols.address), (DEVICE, cols.device))
    entries = [
        F.struct(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_key"))
        for kind, key in roles
        if key in txn.columns
    ]
    return txn.select(
        F.inline(F.array(*entries)),
        F.col(cols.row_id).cast("long").alias("transaction_id"),
        F.col(cols.ts).cast("long").alias("ts"),
    ).filter(F.col("entity_key").isNotNull())


def link_stats(links: DataFrame) -> DataFrame:
    return links.agg(F.count("*").alias("links"), F.count_distinct(*ENTITY).alias("entities"))


def entity_degree(links: DataFrame, hub_degree_max: int = 1000) -> DataFrame:
    return links.groupBy(*ENTITY).agg(F.count("*").alias("degree")).withColumn(
        "is_hub", F.col("degree") > hub_degree_max
    )


def without_hubs(links: DataFrame, hub_degree_max: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links of entities with at most ``hub_degree_max`` links."""
    hubs = entity_degree(links, hub_degree_max).filter("is_hub").select(*ENTITY)
    return spread_join(links, hubs, ENTITY, "left_anti", by=["transaction_id"], hot_rows=hot_rows)


def seed_entities(links: DataFrame, seeds: DataFrame, hub_degree_max: int = 1000) -> DataFrame:
    """Non-hub entities of the seed transactions."""
    kept = without_hubs(links, hub_degree_max)
    return kept.join(seeds.select("transaction_id"), "transaction_id", "left_semi").select(
        F.col("transaction_id").alias("seed_id"), *ENTITY
    )


def _ranges(links: DataFrame, seeds: DataFrame, params: ExpansionParams) -> tuple[DataFrame, DataFrame]:
    """Positions of the links within their entity and, per seed, the range of positions in its window.

    Links and the two window bounds of each seed are put in one order per entity. A hub is
    not among them, so an entity has at most ``hub_degree_max`` links, and the window below
    that many rows times three.
    """
    kept = without_hubs(links, params.hub_degree_max)
    # Links lie with their entity before bounds are added to them. Places and ranges read the same columns
    # of this one shuffle.
    marked = kept.join(
        seeds.select("transaction_id", F.lit(True).alias("is_seed")), "transaction_id", "left"
    ).repartition(*ENTITY)
    ts = F.col("ts")

    def point(at, role, when):
        return F.when(when, F.struct(at.alias("at"), F.lit(role).alias("role")))

    points = marked.select(
        *ENTITY,
        "transaction_id",
        "ts",
        F.inline(
            F.array(
                point(ts, 1, F.lit(True)),
                point(ts - params.back_s, -1, F.col("is_seed")),
                point(ts + params.fwd_s, 0, F.col("is_seed")),
            )
        ),
    ).filter(F.col("at").isNotNull())
    # A bound sorts before the links of its own second: windows are half-open.
    order = Window.partitionBy(*ENTITY).orderBy("at", "role", "transaction_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = points.withColumn("place", F.sum((F.col("role") == 1).cast("long")).over(upto)).withColumn(
        "degree", F.sum((F.col("role") == 1).cast("long")).over(Window.partitionBy(*ENTITY))
    )
    places = counted.filter("role = 1").select(
        *ENTITY, "place", F.col("transaction_id").alias("member_id"), F.col("ts").alias("member_ts")
    )

    def pick(role, name="place"):
        return F.max(F.when(F.col("role") == role, F.col(name)))

    ranges = (
        counted.groupBy(*ENTITY, "transaction_id")
        .agg(pick(-1).alias("low"), pick(0).alias("high"), pick(1).alias("own"), F.max("degree").alias("degree"))
        .filter(F.col("low").isNotNull())
        .select(
            F.col("transaction_id").alias("seed_id"),
            *ENTITY,
            "degree",
            "own",
            (F.col("high") - F.col("low")).alias("in_window"),
            F.greatest(F.col("low"), F.col("high") - params.neighbor_cap).alias("after"),
            "high",
        )
    )
    return places, ranges


def _retained(links: DataFrame, seeds: DataFrame, params: ExpansionParams) -> DataFrame:
    """One row per seed and entity with its retained members as two lists, ``ids`` and ``seconds``.

    The hub limit bounds an entity's list; a seed cuts its range from it, at most
    ``neighbor_cap`` members, so pairs are made where the entity lies and never shuffled one by one.
    """
    places, ranges = _ranges(links, seeds, params)
    lists = (
        places.groupBy(*ENTITY)
        .agg(F.array_sort(F.collect_list(F.struct("place", "member_id", "member_ts"))).alias("all"))
        .select(*ENTITY, F.col("all.member_id").alias("ids"), F.col("all.member_ts").alias("seconds"))
    )

    def cut(name):
        return F.slice(name, (F.col("after") + 1).cast("int"), (F.col("high") - F.col("after")).cast("int")).alias(name)

    # Lists of all entities are as large as the links: not for one broadcast through the driver.
    return ranges.filter("high > after").join(lists.hint("merge"), ENTITY, "inner").select(
        "seed_id", *ENTITY, cut("ids"), cut("seconds")
    )


def _members(lists: DataFrame, *keep: str) -> DataFrame:
    """A row per member of the lists."""
    pairs = F.zip_with("ids", "seconds", lambda i, t: F.struct(i.alias("member_id"), t.alias("member_ts")))
    return lists.select(*keep, F.inline(pairs))


def expand_links(
    links: DataFrame, seeds: DataFrame, params: ExpansionParams = ExpansionParams()
) -> DataFrame:
    """(seed, entity, member): the most recent links of each seed entity inside the seed's window.

    Each seed takes at most ``neighbor_cap`` positions per entity, cut from the entity's list.
    """
    return _members(_retained(links, seeds, params), "seed_id", *ENTITY)


def _near(
    links: DataFrame, seeds: DataFrame, params: ExpansionParams, about: DataFrame, of_seed: Sequence[str]
) -> DataFrame:
    """One row per entity: its links in time order (``all``) and the seeds that take a range of them (``asks``).

    A link knows its transaction's places in entities that come earlier by name (``before``), a seed its ranges
    there (``reach``), so the entity alone can tell which members a seed has from an earlier one.
    The hub limit bounds both lists.
    """
    places, ranges = _ranges(links, seeds, params)
    names = [c for c in about.columns if c != "transaction_id"]
    spots = (
        places.repartition("member_id")
        .groupBy("member_id", "member_ts")
        .agg(F.array_sort(F.collect_list(F.struct(*ENTITY, "place"))).alias("spots"))
        .join(about.withColumnRenamed("transaction_id", "member_id"), "member_id", "left")
        .select("member_id", "member_ts", *names, "spots", F.posexplode("spots").alias("nth", "spot"))
    )
    entity = [F.col(f"spot.{c}").alias(c) for c in ENTITY]
    member = F.struct(
        F.col("spot.place").alias("place"), "member_id", "member_ts", F.slice("spots", F.lit(1), F.col("nth")).alias("before"), *names
    )
    lists = spots.select(*entity, member.alias("m")).groupBy(*ENTITY).agg(F.array_sort(F.collect_list("m")).alias("all"))

    ids = F.col("transaction_id").alias("seed_id")
    own = seeds.groupBy(ids).agg(F.collect_set(F.col("ts").cast("long")).alias("own_ts"))
    reach = (
        ranges.filter("high > after")
        .repartition("seed_id")
        .groupBy("seed_id")
        .agg(F.array_sort(F.collect_list(F.struct(*ENTITY, "after", "high"))).alias("spots"))
        .join(own, "seed_id", "left")
        .join(about.select(ids, *[F.col(c).alias(f"seed_{c}") for c in of_seed]), "seed_id", "left")
        .select("*", F.posexplode("spots").alias("nth", "spot"))
    )
    ask = F.struct(
        "seed_id", F.col("spot.after").alias("after"), F.col("spot.high").alias("high"), "own_ts",
        F.slice("spots", F.lit(1), F.col("nth") + 1).alias("reach"), *[f"seed_{c}" for c in of_seed],
    )
    asks = reach.select(*entity, ask.alias("a")).groupBy(*ENTITY).agg(F.collect_list("a").alias("asks"))
    # Not for a broadcast through the driver: these are as large as the links.
    return lists.join(asks.hint("merge"), ENTITY, "inner")


def _expand_with(
    links: DataFrame, seeds: DataFrame, params: ExpansionParams, about: DataFrame, of_seed: Sequence[str], settle: bool
) -> DataFrame:
    """Members made where the entity lies, each by the first entity that reaches it; no pair is shuffled."""
    names = [c for c in about.columns if c != "transaction_id"]
    kept = cut_lineage if settle else (lambda df: df)
    near = kept(_near(links, seeds, params, about, of_seed))
    cut = F.slice("all", (F.col("after") + 1).cast("int"), (F.col("high") - F.col("after")).cast("int"))
    shown = ["seed_id", *[f"seed_{c}" for c in of_seed]]
    pairs = near.select("all", F.inline("asks")).select("own_ts", "reach", *shown, F.inline(cut))

    def covers(r: Column, b: Column) -> Column:
        same = (r["entity_key"] == b["entity_key"]) & (r["entity_type"] == b["entity_type"])
        return same & (b["place"] > r["after"]) & (b["place"] <= r["high"])

    earlier = F.exists("before", lambda b: F.exists("reach", lambda r: covers(r, b)))
    itself = F.col("member_id").eqNullSafe(F.col("seed_id")) & F.array_contains("own_ts", F.col("member_ts"))
    columns = [*shown, "member_id", "member_ts", *names]
    others = pairs.filter(~earlier & ~itself).select(*columns)
    own = kept(
        seeds.select("transaction_id", F.col("ts").cast("long").alias("member_ts")).distinct()
        .join(about, "transaction_id", "left")
        .select(
            F.col("transaction_id").alias("seed_id"),
            *[F.col(c).alias(f"seed_{c}") for c in of_seed],
            F.col("transaction_id").alias("member_id"),
            "member_ts",
            *names,
        )
    )
    return others.unionByName(own)


def expand(
    links: DataFrame,
    seeds: DataFrame,
    params: ExpansionParams = ExpansionParams(),
    about: DataFrame | None = None,
    of_seed: Sequence[str] = (),
    settle: bool = False,
) -> DataFrame:
    """Members (seed_id, member_id, member_ts) of the neighbourhood of each seed, the seed included.

    ``seeds`` has transaction_id and ts. The lists of a seed are brought together whole and
    become rows, each once, where they arrive.

    ``about`` has one row per transaction_id; its columns then come along with each member and, named in
    ``of_seed``, as ``seed_<name>``, so that what follows needs no join and no shuffle of members.
    ``settle`` writes what the members are made from, not the members, to the checkpoint folder.
    """
    if about is not None:
        return _expand_with(links, seeds, params, about, of_seed, settle)
    reached = _retained(links, seeds, params).select("seed_id", "ids", "seconds")
    own = seeds.select(
        F.col("transaction_id").alias("seed_id"),
        F.array("transaction_id").alias("ids"),
        F.array("ts").alias("seconds"),
    )
    return _members(reached.unionByName(own).repartition("seed_id"), "seed_id").distinct()


def expand_detailed(
    links: DataFrame, seeds: DataFrame, params: ExpansionParams = ExpansionParams()
) -> DataFrame:
    """Per seed and entity: degree, links in the window, retained neighbours, whether a hub or capped."""
    _, ranges = _ranges(links, seeds, params)
    own_taken = ((F.col("own") > F.col("after")) & (F.col("own") <= F.col("high"))).cast("long")
    kept = ranges.select(
        "seed_id",
        *ENTITY,
        "degree",
        F.lit(False).alias("pruned"),
        F.col("in_window").alias("neighbors_in_window"),
        (F.col("high") - F.col("after") - own_taken).alias("retained_neighbors"),
        (F.col("in_window") > params.neighbor_cap).alias("cap_applied"),
    )
    pruned = _seed_hubs(links, seeds, params).select(
        "seed_id",
        *ENTITY,
        "degree",
        F.lit(True).alias("pruned"),
        F.lit(None).cast("long").alias("neighbors_in_window"),
        F.lit(0).cast("long").alias("retained_neighbors"),
        F.lit(False).alias("cap_applied"),
    )
    return kept.unionByName(pruned)


def _seed_hubs(links: DataFrame, seeds: DataFrame, params: ExpansionParams) -> DataFrame:
    hubs = entity_degree(links, params.hub_degree_max).filter("is_hub").select(*ENTITY, "degree")
    of_seeds = links.join(seeds.select("transaction_id"), "transaction_id", "left_semi").select(
        F.col("transaction_id").alias("seed_id"), *ENTITY
    )
    return spread_join(of_seeds, hubs, ENTITY, "inner", by=["seed_id"])


def held_entities(links: DataFrame, params: ExpansionParams = ExpansionParams()) -> DataFrame:
    """The non-hub entities of each transaction as one list, once per link."""
    kept = without_hubs(links, params.hub_degree_max).filter(F.col("transaction_id").isNotNull())
    return kept.groupBy("transaction_id").agg(F.collect_list(F.struct(*ENTITY)).alias("entities"))


def incidence(
    links: DataFrame, members: DataFrame, seeds: DataFrame, params: ExpansionParams = ExpansionParams()
) -> DataFrame:
    """Edges from members to the entities of their seed (seed_id, member_id, entity).

    Members that carry their ``entities`` (``expand`` with ``held_entities``) become edges where they are.
    """
    if {"entities", "seed_entities"} <= set(members.columns):
        of_seed = F.filter("entities", lambda e: F.array_contains("seed_entities", e))
        return members.select("seed_id", "member_id", "member_ts", F.inline(of_seed))
    kept = without_hubs(links, params.hub_degree_max)
    held = members.join(
        kept.select(F.col("transaction_id").alias("member_id"), *ENTITY), "member_id", "inner"
    )
    of_seed = kept.join(seeds.select("transaction_id"), "transaction_id", "left_semi").select(
        F.col("transaction_id").alias("seed_id"), *ENTITY
    )
    return held.join(of_seed, ["seed_id", *ENTITY], "left_semi").select("seed_id", "member_id", "member_ts", *ENTITY)


def expansion_graph(
    links: DataFrame, seeds: DataFrame, params: ExpansionParams = ExpansionParams()
) -> tuple[DataFrame, DataFrame]:
    """Nodes (transactions and entities) and HAS_ENTITY edges of each seed's neighbourhood."""
    members = expand(links, seeds, params, held_entities(links, params), ["entities"])
    transactions = members.select(
        "seed_id",
        F.concat(F.lit("txn:"), F.col("member_id")).alias("node_id"),
        F.lit("TRANSACTION").alias("node_type"),
        (F.col("member_id") == F.col("seed_id")).alias("is_seed"),
    )
    entities = seed_entities(links, seeds, params.hub_degree_max).select(
        "seed_id",
        F.concat_ws(":", "entity_type", "entity_key").alias("node_id"),
        F.col("entity_type").alias("node_type"),
        F.lit(False).alias("is_seed"),
    )
    edges = incidence(links, members, seeds, params).select(
        "seed_id",
        F.concat(F.lit("txn:"), F.col("member_id")).alias("source"),
        F.concat_ws(":", "entity_type", "entity_key").alias("target"),
        F.lit("HAS_ENTITY").alias("relationship_type"),
    )
    return transactions.unionByName(entities), edges


def _hours(seconds: Column) -> Column:
    """Hours with two digits, rounded half up in whole numbers."""
    return F.floor((seconds * 2 + 36) / 72) / F.lit(100.0)


def held_scores(scores: DataFrame) -> DataFrame:
    """The scores of each transaction as one list of structs."""
    known = [c for c in ("risk_score", "risk_band") if c in scores.columns]
    told = scores.filter(F.col("transaction_id").isNotNull())
    return told.groupBy("transaction_id").agg(F.collect_list(F.struct(*known)).alias("scores"))


def community_summary(
    links: DataFrame,
    seeds: DataFrame,
    scores: DataFrame,
    params: ExpansionParams = ExpansionParams(),
    members: DataFrame | None = None,
    ids: bool = False,
) -> DataFrame:
    """Size, time span, entity counts and highest score of each seed's community.

    All members share an entity with the seed, so the community is the whole expansion.
    ``scores`` has transaction_id and risk_score. Members that carry their ``scores`` (a list of
    structs with risk_score) are counted where they are. With ``ids`` the set of member ids comes along,
    gathered by the same pass over the members.
    """
    members = members if members is not None else expand(links, seeds, params, held_scores(scores))
    if "scores" in members.columns:
        scored = members.select(
            "seed_id",
            "member_id",
            "member_ts",
            F.greatest(F.size("scores"), F.lit(1)).alias("rows"),
            F.array_max(F.transform("scores", lambda s: s["risk_score"])).alias("risk_score"),
        )
    else:
        scored = members.join(
            scores.select(F.col("transaction_id").alias("member_id"), "risk_score"), "member_id", "left"
        ).withColumn("rows", F.lit(1))
    sizes = scored.groupBy("seed_id").agg(
        F.sum("rows").alias("transaction_count"),
        _hours(F.max("member_ts") - F.min("member_ts")).alias("time_span_hours"),
        F.round(F.coalesce(F.max("risk_score"), F.lit(0.0)), 4).alias("max_risk_score"),
        *([F.collect_set("member_id").alias("ids")] if ids else []),
    )
    hubs = entity_degree(links, params.hub_degree_max).filter("is_hub").select(*ENTITY, "is_hub")
    of_seeds = links.join(seeds.select("transaction_id"), "transaction_id", "left_semi").select(
        F.col("transaction_id").alias("seed_id"), *ENTITY
    )
    entities = spread_join(of_seeds, hubs, ENTITY, "left", by=["seed_id"])
    used = F.col("is_hub").isNull()
    counts = entities.groupBy("seed_id").agg(
        F.count_if(used).alias("entity_count"),
        *[F.count_if(used & (F.col("entity_type") == t)).alias(f"{t.lower()}_count") for t in (CARD, ADDRESS, DEVICE)],
        F.count_if(~used).alias("hub_pruned_count"),
    )
    names = ["entity_count", "card_count", "address_count", "device_count", "hub_pruned_count"]
    return sizes.join(counts, "seed_id", "left").select(
        "seed_id",
        "transaction_count",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        "time_span_hours",
        "max_risk_score",
        *(["ids"] if ids else []),
    )


def graph_context(
    links: DataFrame, seeds: DataFrame, scores: DataFrame, params: ExpansionParams = ExpansionParams()
) -> DataFrame:
    """One row per seed: own score, community summary, time window and the parameters' hash."""
    seeds = seeds.select("transaction_id", "ts")
    own = seeds.join(scores.select("transaction_id", "risk_score"), "transaction_id", "left").select(
        F.col("transaction_id").alias("seed_id"),
        F.col("ts").alias("seed_ts"),
        "risk_score",
        (F.col("ts") - params.back_s).alias("window_start"),
        (F.col("ts") + params.fwd_s).alias("window_end"),
        F.lit(params.graph_version).alias("graph_version"),
        F.lit(params.digest()).alias("params_hash"),
    )
    return own.join(community_summary(links, seeds, scores, params), "seed_id", "left")


def window_neighbours(
    links: DataFrame, queries: DataFrame, params: ExpansionParams = ExpansionParams()
) -> DataFrame:
    """All links of a queried non-hub entity in [t - back, t + fwd), for queries (query_id, entity, t).

    Bounds and links are put in one order per entity, as for an expansion; the hub limit
    bounds the links of an entity. Queries are counted into the same order.
    """
    kept = without_hubs(links, params.hub_degree_max)
    order = Window.partitionBy(*ENTITY).orderBy("ts", "transaction_id")
    places = kept.select(*ENTITY, "transaction_id", "ts", F.row_number().over(order).alias("place"))
    marks = places.groupBy(*ENTITY).agg(F.array_sort(F.collect_list("ts")).alias("seconds"))
    bounds = spread_join(queries, marks, ENTITY, "inner", by=["query_id"])

    def before(at):
        return F.size(F.filter("seconds", lambda s: s < at))

    taken = bounds.select(
        "query_id",
        *ENTITY,
        before(F.col("t") - params.back_s).alias("low"),
        before(F.col("t") + params.fwd_s).alias("high"),
    ).filter("high > low")
    wanted = taken.select(
        "query_id", *ENTITY, F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("place")
    )
    return wanted.join(places, [*ENTITY, "place"], "inner").select("query_id", *ENTITY, "transaction_id", "ts")
