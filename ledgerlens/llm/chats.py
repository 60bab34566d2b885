"""Chat formatting with minimum-cost repair of roles.

A legal chat is a path through an automaton: an optional system turn first, then user and
assistant in turn. Dynamic programming over its states chooses for every input turn the
cheapest of: keep it, relabel it, merge it into the turn before, each with or without an
empty turn inserted before it. The repaired turns are rendered piece by piece; the pieces
of a conversation, joined in order, are its text for training.

A conversation is cut into chunks of ``CHUNK`` turns by rank, so none has to fit into a
task, whatever its turn numbers are: the first pass gives each chunk's cost from any state
to any state, the second composes these along the conversation, ``CHUNK`` of them at a time
and level by level, and fixes the states between chunks, the third repairs every chunk
between its two states. Most conversations are one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.scratch import Scratch

CHUNK = 512
# Characters of a text that order turns of equal number and role; then a hash of the text does.
PREFIX = 64

# States: the role of the last turn so far; START before any.
STATES = ("start", "system", "user", "assistant")
ROLES = ("system", "user", "assistant")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
RELABEL, RELABEL_UNKNOWN, MERGE_SAME, MERGE_OTHER, INSERT = 1.0, 0.5, 0.4, 1.2, 0.8

OUT = "conv_id bigint, chunk bigint, place bigint, turn bigint, action string, role string, inserted string, piece string"


def moves(state: str, role: str | None) -> list[tuple[float, str, str, str | None]]:
    """(cost, next state, action, role inserted before), cheapest first and in a fixed order.

    A role outside the three is unknown; giving it any role is cheap.
    """
    known = role in ROLES
    found = []
    for put in (None, *LEGAL[state]):
        at, cost = (state, 0.0) if put is None else (put, INSERT)
        for new in LEGAL[at]:
            if new == role:
                found.append((cost, new, "keep", put))
            else:
                found.append((cost + (RELABEL if known else RELABEL_UNKNOWN), new, "relabel", put))
        if put is None and at != "start":
            found.append((MERGE_SAME if at == role else MERGE_OTHER, at, "merge", None))
    return sorted(found, key=lambda m: m[0])


_MOVES = {(s, r): moves(s, r) for s in STATES for r in (*ROLES, None)}


def _role(value: str | None) -> str | None:
    value = value.strip().lower() if isinstance(value, str) else None
    return value if value in ROLES else None


def costs(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state before these turns to each state after them."""
    table = np.full((4, 4), np.inf)
    np.fill_diagonal(table, 0.0)
    for role in roles:
        after = np.full((4, 4), np.inf)
        for i, state in enumerate(STATES):
            for cost, new, _, _ in _MOVES[state, role]:
                j = STATES.index(new)
                after[:, j] = np.minimum(after[:, j], table[:, i] + cost)
        table = after
    return table


def repair(roles: list[str | None], entry: str = "start", leave: str | None = None) -> list[tuple[str, str, str | None]]:
    """(action, role, role inserted before) of each turn, from ``entry`` to ``leave`` (any if None)."""
    best = {entry: (0.0, None)}
    trail = []
    for role in roles:
        now: dict[str, tuple[float, tuple]] = {}
        for state in STATES:
            if state not in best:
                continue
            for cost, new, action, put in _MOVES[state, role]:
                total = best[state][0] + cost
                if new not in now or total < now[new][0] - 1e-9:
                    now[new] = (total, (state, action, put))
        trail.append(now)
        best = now
    end = leave or min(best, key=lambda s: (best[s][0], STATES.index(s)))
    chosen = []
    for step in reversed(trail):
        state, action, put = step[end][1]
        chosen.append((action, end, put))
        end = state
    return chosen[::-1]


def piece(action: str, role: str, inserted: str | None, text: str) -> str:
    """What a turn adds to the rendered conversation."""
    before = f"<|{inserted}|>\n\n" if inserted else ""
    return before + (f"{text}\n" if action == "merge" else f"<|{role}|>\n{text}\n")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal keys over batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    now = None
    for batch in batches:
        if batch.empty:
            continue
        code = (batch[keys] != batch[keys].shift()).any(axis=1).cumsum()
        for _, part in batch.groupby(code, sort=False):
            key = tuple(part[keys].iloc[0])
            if key != now and held:
                yield now, pd.concat(held)
                held = []
            now = key
            held.append(part)
    if held:
        yield now, pd.concat(held)


def ranked(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) plus ``rank``, the position in the conversation from 0.

    All rows are sorted by ranges, so a conversation, a turn number or a text that holds a
    large share of them spreads over many tasks. A range counts along its own rows; only
    its first conversation can have begun before, so one row per range goes to the driver.
    """
    place = [
        F.col("conv_id"),
        F.col("turn").asc_nulls_last(),
        F.col("role"),
        F.col("_prefix"),
        F.col("_hash"),
        F.col("_number"),
    ]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            new = np.append(True, conv[1:] != conv[:-1])
            first = np.flatnonzero(new)
            local = np.arange(len(conv)) - first[np.cumsum(new) - 1]
            if conv[0] == now:
                local[: first[1] if len(first) > 1 else len(conv)] += seen
            now, seen = conv[-1], local[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(conv), part, np.int32)), pa.array(local)],
                names=["conv_id", "turn", "role", "text", "part", "local"],
            )

    rows = scratch.keep(
        turns.withColumns(
            {"_prefix": F.substring("text", 1, PREFIX), "_hash": F.xxhash64("text"), "_number": F.monotonically_increasing_id()}
        )
        .repartitionByRange(*place)
        .sortWithinPartitions(*place)
        .select("conv_id", "turn", "role", "text")
        .mapInArrow(count, "conv_id bigint, turn bigint, role string, text string, part int, local bigint"),
        "ranked",
    )
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last")).collect()
    before, open_conv, total = [], None, 0
    for r in sorted(ends, key=lambda r: r["part"]):
        base = total if r["first"] == open_conv else 0
        if base:
            before.append((r["part"], r["first"], base))
        open_conv = r["last"]["conv_id"]
        total = r["last"]["local"] + 1 + (base if open_conv == r["first"] else 0)
    bases = turns.sparkSession.createDataFrame(before, "part int, conv_id bigint, base bigint")
    return rows.join(F.broadcast(bases), ["part", "conv_id"], "left").select(
        "conv_id", "turn", "role", "text", (F.col("local") + F.coalesce("base", F.lit(0))).alias("rank")
    )


def _along(tables: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """The states before, between and after chunks with these costs, on a cheapest path."""
    best, back = np.full(4, np.inf), []
    best[entry] = 0.0
    for t in tables:
        total = best[:, None] + t
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    states = [int(best.argmin()) if leave is None else leave]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def between_chunks(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, chunk, entry, leave): the states around each of ``chunks`` (conv_id, chunk, costs).

    ``CHUNK`` chunks at a time are composed to one of the next level, until each
    conversation is one group; then the states are fixed from the top level down.
    """
    keys = ["conv_id", "above"]

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (conv, above), rows in _groups(batches, keys):
            table = np.full((4, 4), np.inf)
            np.fill_diagonal(table, 0.0)
            for c in rows["costs"]:
                table = (table[:, :, None] + np.array(c).reshape(1, 4, 4)).min(axis=1)
            yield pd.DataFrame({"conv_id": [conv], "chunk": [above], "costs": [table.ravel()]})

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (conv, _), rows in _groups(batches, keys):
            leave = rows["leave"].iloc[0]
            states = _along(
                [np.array(c).reshape(4, 4) for c in rows["costs"]],
                STATES.index(rows["entry"].iloc[0]),
                STATES.index(leave) if leave else None,
            )
            yield pd.DataFrame(
                {
                    "conv_id": conv,
                    "chunk": rows["chunk"].to_numpy(),
                    "entry": [STATES[s] for s in states[:-1]],
                    "leave": [STATES[s] for s in states[1:]],
                }
            )

    def grouped(level: DataFrame) -> DataFrame:
        return level.withColumn("above", F.floor(F.col("chunk") / CHUNK))

    def dealt(level: DataFrame) -> DataFrame:
        return level.repartition(*keys).sortWithinPartitions(*keys, "chunk")

    levels = [grouped(chunks)]
    while (levels[-1].agg(F.max("above")).first()[0] or 0) > 0:
        up = dealt(levels[-1]).select(*keys, "costs").mapInPandas(compose, "conv_id bigint, chunk bigint, costs array<double>")
        levels.append(grouped(scratch.keep(up, f"level-{len(levels)}")))
    top = levels[-1].withColumns({"entry": F.lit("start"), "leave": F.lit(None).cast("string")})
    for level in [*reversed(levels[:-1]), None]:
        fixed = dealt(top).mapInPandas(fix, "conv_id bigint, chunk bigint, entry string, leave string")
        if level is not None:
            top = level.join(fixed.withColumnRenamed("chunk", "above"), keys)
    return fixed


def repair_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, chunk, place, turn, action, role, inserted, piece.

    Turns follow each other by turn number, then by role and text (its first ``PREFIX``
    characters, then a hash of it), turns without a number last; (chunk, place) is that
    order. Rows without conv_id form one conversation. Null texts are empty, null and
    unknown roles get a role, repeated rows stay repeated turns. Other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "chats")
    none = F.lit(-(1 << 63))
    turns = ranked(
        conversations.select(
            F.coalesce(F.col("conv_id").cast("long"), none).alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.col("role").cast("string").alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ),
        scratch,
    ).withColumn("chunk", F.floor(F.col("rank") / CHUNK))
    order = ["conv_id", "chunk", "rank"]

    def chunk_costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (conv, chunk), rows in _groups(batches, ["conv_id", "chunk"]):
            yield pd.DataFrame({"conv_id": [conv], "chunk": [chunk], "costs": [costs([_role(r) for r in rows["role"]]).ravel()]})

    # The chunks of conversations with more than one.
    later = turns.filter((F.col("rank") > 0) & (F.col("rank") % CHUNK == 0)).select("conv_id", "chunk")
    several = later.union(later.filter("chunk = 1").select("conv_id", F.lit(0).cast("long").alias("chunk")))
    chunks = scratch.keep(
        turns.select("conv_id", "chunk", "rank", "role")
        .join(several, ["conv_id", "chunk"], "left_semi")
        .repartition("conv_id", "chunk")
        .sortWithinPartitions(*order)
        .select("conv_id", "chunk", "role")
        .mapInPandas(chunk_costs, "conv_id bigint, chunk bigint, costs array<double>"),
        "costs",
    )
    fixed = between_chunks(chunks, scratch)

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (conv, chunk), rows in _groups(batches, ["conv_id", "chunk"]):
            entry, leave = rows["entry"].iloc[0], rows["leave"].iloc[0]
            found = repair([_role(r) for r in rows["role"]], entry or "start", leave or None)
            yield pd.DataFrame(
                {
                    "conv_id": conv,
                    "chunk": chunk,
                    "place": range(len(rows)),
                    "turn": rows["turn"].to_numpy(),
                    "action": [a for a, _, _ in found],
                    "role": [r for _, r, _ in found],
                    "inserted": [i for _, _, i in found],
                    "piece": [piece(a, r, i, t) for (a, r, i), t in zip(found, rows["text"])],
                }
            )

    rows = (
        turns.join(fixed, ["conv_id", "chunk"], "left")
        .repartition("conv_id", "chunk")
        .sortWithinPartitions(*order)
        .select("conv_id", "chunk", F.col("turn").cast("double").alias("turn"), "role", "text", "entry", "leave")
    )
    result = rows.mapInPandas(render, OUT.replace("turn bigint", "turn double"))
    return result.withColumn("turn", F.when(~F.isnan("turn"), F.col("turn")).cast("long")).withColumn(
        "conv_id", F.nullif("conv_id", none)
    )
