"""Temperature mixing of sources, with DataFrame functions only.

A source with share p of all tokens gets a weight in proportion to p^a. At a = 1 the mix is
the corpus, at a = 0 all sources weigh the same. The exponent is bisected (16 cuts a pass,
each one aggregation over the sources) until the mix has a target entropy, or is as even
as a limit on repetitions allows.

Weights become whole *blocks*: a source's quota of the token budget is as many full copies
as fit, each block a fresh permutation of its documents, and a last block cut where the
budget ends. The cut is a position in the permutation, found from totals over ordered
levels of the permutation key, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.scratch import Scratch
from ledgerlens.operators.running import prior_totals
from ledgerlens.operators.spread import spread_join

CUTS = 16
PASSES = 6
REPEATS = 4.0
# Sources up to this many are sent to all tasks; more are joined by a shuffle.
SMALL = 10_000


def _solve(sources: DataFrame, total: float, budget: float, entropy: float | None, repeats: float) -> float:
    """The least exponent in [0, 1] whose mix is no more even than asked."""
    low, high = 0.0, 1.0
    share = F.col("tokens") / F.lit(total)
    for _ in range(PASSES):
        cuts = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
        measures = []
        for i, a in enumerate(cuts):
            weight = F.pow(share, F.lit(a))
            measures += [
                F.sum(weight).alias(f"z{i}"),
                F.sum(weight * a * F.log(share)).alias(f"s{i}"),
                F.max(weight / F.col("tokens")).alias(f"m{i}"),
            ]
        row = sources.agg(*measures).first()

        def fits(i: int) -> bool:
            z = row[f"z{i}"]
            if entropy is not None:
                import math

                return math.log(z) - row[f"s{i}"] / z <= entropy
            return row[f"m{i}"] / z * budget <= repeats

        first = next((i for i in range(CUTS + 1) if fits(i)), CUTS)
        low, high = cuts[max(first - 1, 0)], cuts[first]
    return high


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row is permuted by: its id and its text, so rows without id have keys of their own."""
    return F.xxhash64(F.col(doc_id).cast("long"), text)


def permutation_key(row: Column, epoch: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(row, epoch.cast("long"), F.lit(seed)), 1)


def mixing_plan(documents: DataFrame, budget: float | None, entropy: float | None, repeats: float, seed: int) -> DataFrame:
    """(source, tokens, weight, blocks, cut): full blocks and where the last one ends, per source."""
    scratch = Scratch(documents.sparkSession, "mixing")
    narrow = documents.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        row_key().alias("row"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long").alias("n_tokens"),
    )
    narrow = scratch.keep(narrow, "tokens")
    sources = scratch.keep(narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    full = sources.filter("tokens > 0")
    total = full.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget is None else budget)
    exponent = _solve(full, total, budget, entropy, repeats) if total else 1.0
    raised = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))
    whole = full.agg(F.sum(raised)).first()[0] or 1.0
    quota = F.when(F.col("tokens") > 0, F.col("weight") * budget).otherwise(F.lit(0.0))
    plan = (
        sources.withColumn("weight", F.when(F.col("tokens") > 0, raised / F.lit(whole)).otherwise(0.0))
        .withColumn("blocks", F.coalesce(F.floor((quota + 1e-6) / F.nullif("tokens", F.lit(0))), F.lit(0)).cast("int"))
        .withColumn("rest", F.greatest(quota - F.col("blocks") * F.col("tokens"), F.lit(0.0)))
    )
    plan = scratch.keep(plan, "plan")
    small = plan.count() <= SMALL
    planned = narrow.join(F.broadcast(plan), "source") if small else spread_join(narrow, plan, ["source"], by=["row"])
    keyed = planned.select("source", "rest", permutation_key(F.col("row"), F.col("blocks"), seed).alias("key"), "n_tokens")
    steps = keyed.select(
        "source",
        F.shiftright("key", 51).alias("first"),
        F.shiftright("key", 39).alias("second"),
        "key",
        "n_tokens",
        "rest",
    ).groupBy("source", "first", "second", "key").agg(F.sum("n_tokens").alias("own"), F.max("rest").alias("rest"))
    running = prior_totals(steps, ["source"], ["first", "second", "key"], sums=["own"])
    cuts = running.filter("prior_own + own > rest").groupBy("source").agg(F.min("key").alias("cut"))
    return scratch.keep(
        plan.join(cuts, "source", "left").select(
            "source", "tokens", "weight", "blocks", F.coalesce("cut", F.lit((1 << 63) - 1)).alias("cut")
        ),
        "cuts",
    )


def mix_sources(
    documents: DataFrame,
    budget: float | None = None,
    entropy: float | None = None,
    repeats: float = REPEATS,
    seed: int = 8,
) -> DataFrame:
    """``documents``, each row as often as the mix wants it, with ``mix_block`` and ``mix_key``.

    ``budget`` is in tokens (words between white space; default: those of the corpus).
    With ``entropy`` (nats) the mix has that entropy, as far as exponents from 0 to 1
    reach; else no source repeats more than ``repeats`` times. Sorting by ``mix_block`` and
    ``mix_key`` gives the permuted blocks. A null source is a source of its own, the empty
    name; a source without tokens is left out. Rows of equal doc_id and text move together;
    rows without id are told apart by their text. Columns that clash with the two new ones
    are replaced, others keep their names and values.
    """
    plan = mixing_plan(documents, budget, entropy, repeats, seed)
    small = plan.count() <= SMALL
    kept = [c for c in documents.columns if c not in {"mix_block", "mix_key"}]
    # Names that no column of the documents has.
    source, row, blocks, cut, copies = (f"{'_' * (1 + max(map(len, kept)))}{c}" for c in ("source", "row", "blocks", "cut", "copies"))
    plan = plan.select(F.col("source").alias(source), F.col("blocks").alias(blocks), F.col("cut").alias(cut))
    rows = documents.select(*kept).withColumns({source: F.coalesce(F.col("source").cast("string"), F.lit("")), row: row_key()})
    rows = rows.join(F.broadcast(plan), source) if small else spread_join(rows, plan, [source], by=[row])
    last = permutation_key(F.col(row), F.col(blocks), seed) < F.col(cut)
    return (
        rows.withColumn(copies, F.col(blocks) + F.when(last, 1).otherwise(0))
        .filter((F.col(copies) > 0) & ((F.col(cut) < (1 << 63) - 1) | (F.col(blocks) > 0)))
        .withColumn("mix_block", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        .withColumn("mix_key", permutation_key(F.col(row), F.col("mix_block"), seed))
        .select(*kept, "mix_block", "mix_key")
    )
