"""Connected components, strong ties and how well they match known rings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.spread import HOT_ROWS, spread_join
from ledgerlens.session import cut_lineage


def strong_ties(txn: DataFrame, account: str, shared: Sequence[str]) -> DataFrame:
    """Distinct (account, tie) edges for accounts that share a device, an instrument, ....

    The ties stay nodes of their own, so a key shared by n accounts gives n edges, not n².
    Keys used by a single account tie nothing and are left out.
    """
    entries = [
        F.struct(F.lit(name).alias("tie_type"), F.col(name).cast("string").alias("tie_key")) for name in shared
    ]
    edges = (
        txn.select(F.col(account).cast("string").alias("account"), F.inline(F.array(*entries)))
        .filter(F.col("tie_key").isNotNull() & F.col("account").isNotNull())
        .distinct()
    )
    users = edges.groupBy("tie_type", "tie_key").agg(F.count("*").alias("users"))
    busy = users.filter("users > 1").drop("users")
    return spread_join(edges, busy, ["tie_type", "tie_key"], "left_semi", by=["account"])


def connected_components(
    edges: DataFrame,
    first: str,
    second: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(node, component): the component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which turn
    every component into a star around its smallest node in few rounds, whatever the
    degrees. The smallest neighbours only become smaller, so the rounds end. Each step is
    written to the checkpoint folder, so a lost executor costs one step at most.
    """
    links = edges.select(F.col(first).alias("u"), F.col(second).alias("v")).filter("u != v")
    nodes = (
        edges.select(F.col(first).alias("node"))
        .union(edges.select(F.col(second).alias("node")))
        .distinct()
    )
    links = cut_lineage(links.distinct())
    seen = None
    while True:
        links = cut_lineage(_large_star(links, hot_rows))
        links = cut_lineage(_small_star(links, hot_rows))
        state = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == state:
            stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.join(stars, "node", "left").select(
                "node", F.coalesce("component", "node").alias("component")
            )
        seen = state


def _smallest(both_ways: DataFrame) -> DataFrame:
    return both_ways.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))


def _with_low(edges: DataFrame, low: DataFrame, hot_rows: int) -> DataFrame:
    return spread_join(edges, low, ["u"], "inner", by=["v"], hot_rows=hot_rows)


def _large_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Connect the larger neighbours of each node to its smallest one."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _with_low(both, _smallest(both), hot_rows)
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest(down)
    joined = _with_low(down, low, hot_rows)
    moved = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    return moved.filter("u != v").distinct()


def component_purity(components: DataFrame, rings: DataFrame, min_size: int = 3) -> DataFrame:
    """Size, ring members, purity and dominant ring of each component with at least ``min_size`` nodes.

    ``components``: (node, component); ``rings``: (ring, node). Ties go to the smallest ring.
    """
    marked = components.join(rings.select("node", "ring"), "node", "left")
    cells = marked.groupBy("component", "ring").agg(F.count("*").alias("n"))
    dominant = (
        cells.filter("ring IS NOT NULL")
        .groupBy("component")
        .agg(F.min_by("ring", F.struct(-F.col("n"), "ring")).alias("dominant_ring"))
    )
    sizes = cells.groupBy("component").agg(
        F.sum("n").alias("size"),
        F.coalesce(F.sum(F.when(F.col("ring").isNotNull(), F.col("n"))), F.lit(0)).alias("ring_members"),
    )
    return (
        sizes.filter(F.col("size") >= min_size)
        .join(dominant, "component", "left")
        .select(
            "component",
            "size",
            "ring_members",
            F.round(F.col("ring_members") / F.col("size"), 3).alias("purity"),
            F.coalesce("dominant_ring", F.lit("-")).alias("dominant_ring"),
        )
    )


def ring_recovery(purity: DataFrame, rings: DataFrame, min_purity: float = 0.5) -> DataFrame:
    """Per ring: was it found, judged by the component it dominates with the most ring members."""
    largest = F.struct(-F.col("ring_members"), F.col("component"))
    top = purity.groupBy(F.col("dominant_ring").alias("ring")).agg(
        F.min_by("purity", largest).alias("best_purity")
    )
    return (
        rings.select("ring")
        .distinct()
        .join(top, "ring", "left")
        .select(
            "ring", F.coalesce(F.col("best_purity") >= min_purity, F.lit(False)).alias("recovered"), "best_purity"
        )
    )


def rings_from_mapping(truth: DataFrame, mapping: str = "rings") -> DataFrame:
    """(ring, node) rows from a map column ring → array of accounts."""
    return truth.select(F.explode(mapping).alias("ring", "nodes")).select(
        "ring", F.explode(F.col("nodes").cast("array<string>")).alias("node")
    )
