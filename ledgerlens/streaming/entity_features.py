"""Entity history over a stream, equal to the batch result on the same rows.

Rows are first aggregated per entity, partner and second, so a busy entity sends at most one
row per second and partner of event time to its state, whatever its number of transactions.
The aggregation emits a second only after the watermark has passed it; seconds therefore
reach the state in order, and it can be read first and updated afterwards.
Rows later than the watermark are dropped; Spark counts them as
``numRowsDroppedByWatermark`` in the progress of the query.

What lies in a window is kept in slots of ten minutes. A step forward in time reads only the
slots that fall out of the window, and an event-time timer empties the windows of an entity
that has been idle for longer than its longest one. Running totals stay, as later rows need them.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ledgerlens.functions.scalars import DAY_S, HOUR_S, hour_of
from ledgerlens.operators.history import (
    ADDRESS, ADDRESS_CARD, CARD, DEVICE, DEVICE_CARD, NOTHING, TxnColumns, fold_relational, observations,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOT_S = 600

# Seconds for which a partner counts.
PARTNER_S = {CARD: DAY_S, DEVICE: DAY_S, ADDRESS: 7 * DAY_S}

OUTPUT = StructType(
    [
        StructField("kind", StringType()),
        StructField("key", StringType()),
        StructField("partner", StringType()),
        StructField("at", TimestampType()),
        StructField("ts", LongType()),
        StructField("seen", LongType()),
        StructField("last_ts", LongType()),
        StructField("known", LongType()),
        StructField("mean", DoubleType()),
        StructField("squares", DoubleType()),
        StructField("deviation", DoubleType()),
        StructField("east", DoubleType()),
        StructField("north", DoubleType()),
        StructField("in_1h", LongType()),
        StructField("in_24h", LongType()),
        StructField("joint", LongType()),
        StructField("active", LongType()),
    ]
)
_WHOLE = ("ts", "seen", "last_ts", "known", "in_1h", "in_24h", "joint", "active")


def _struct(kind, *names: str) -> StructType:
    return StructType([StructField(n, kind) for n in names])


_TOTALS = StructType(
    [
        *_struct(LongType(), "seen", "last", "known", "joint", "in_1h", "in_24h", "active", "timer").fields,
        *_struct(DoubleType(), "mean", "squares", "east", "north").fields,
    ]
)
_SECONDS = _struct(ArrayType(LongType()), "ts", "rows")
_PARTNERS = StructType([StructField("ts", ArrayType(LongType())), StructField("partner", ArrayType(StringType()))])


class EntityHistory(StatefulProcessor):
    """State of one entity: running totals, slots of rows per second, slots of partners and when each was last met."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        slot = _struct(LongType(), "slot")
        self._totals = handle.getValueState("totals", _TOTALS)
        self._seconds = handle.getMapState("seconds", slot, _SECONDS)
        self._met = handle.getMapState("met", slot, _PARTNERS)
        self._partner = handle.getMapState("partner", _struct(StringType(), "partner"), _struct(LongType(), "ts"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        kind = key[0]
        state = self._totals.get() if self._totals.exists() else (0, None, 0, 0, 0, 0, 0, None, 0.0, 0.0, 0.0, 0.0)
        seen, last, known, joint, in_1h, in_24h, active, timer, mean, squares, east, north = state
        window = PARTNER_S.get(kind)
        # The slots in use, ascending: at most a week of them, read once per micro-batch.
        self._known = {m: sorted(k[0] for k in m.keys()) if window else [] for m in (self._seconds, self._met)}
        out = []
        for ts, second in arrived.groupby("ts"):
            ts = int(ts)
            if last is not None and window:
                in_1h -= self._rows_between(last - HOUR_S, ts - HOUR_S)
                in_24h -= self._rows_between(last - DAY_S, ts - DAY_S)
                active -= self._lapsed(last - window, ts - window)
                self._forget(self._seconds, ts - DAY_S)
                self._forget(self._met, ts - window)
            out.append(
                (
                    *key, second["at"].iloc[0], ts, seen, last, known,
                    mean if known else None,
                    squares if known else None,
                    math.sqrt(squares / known) if known else None,
                    east / seen if seen else None,
                    north / seen if seen else None,
                    in_1h, in_24h, joint, active,
                )
            )
            count = 0
            for row in second.itertuples(index=False):
                if row.amounts:
                    here = row.total / row.amounts
                    gap, both = here - mean, known + int(row.amounts)
                    squares += row.inner + gap * gap * known * row.amounts / both
                    mean += gap * row.amounts / both
                    known = both
                count += int(row.rows)
                east, north = east + row.east, north + row.north
                if window and isinstance(row.other, str):
                    joint += int(row.rows)
                    active += self._meet(row.other, ts)
            seen, last = seen + count, ts
            if window:
                in_1h, in_24h = in_1h + count, in_24h + count
                self._append(self._seconds, ts, count)
        if window:
            if timer is not None:
                self._handle.deleteTimer(timer)
            timer = int(arrived["at_ms"].max()) + (max(window, DAY_S) + 1) * 1000
            self._handle.registerTimer(timer)
        self._totals.update((seen, last, known, joint, in_1h, in_24h, active, timer, float(mean), float(squares), float(east), float(north)))
        frame = pd.DataFrame(out, columns=OUTPUT.names)
        yield frame.astype({c: "Int64" for c in _WHOLE})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing happened for longer than the longest window: all windows are empty."""
        state = list(self._totals.get())
        if state[7] == expiredTimerInfo.getExpiryTimeInMs():
            for windows in (self._seconds, self._met, self._partner):
                windows.clear()
            # The rows to subtract are gone, so the counts are zero from here on.
            state[4:8] = [0, 0, 0, None]
            self._totals.update(tuple(state))
        yield pd.DataFrame([], columns=OUTPUT.names)

    def _slots(self, states, start: int, end: int) -> Iterator[tuple[list, list]]:
        """Slots that may hold a second in [start, end)."""
        known = self._known[states]
        for slot in known[bisect_left(known, start // SLOT_S) : bisect_right(known, (end - 1) // SLOT_S)]:
            yield states.getValue((slot,))

    def _rows_between(self, start: int, end: int) -> int:
        """Rows of seconds in [start, end)."""
        return sum(n for ts, rows in self._slots(self._seconds, start, end) for t, n in zip(ts, rows) if start <= t < end)

    def _lapsed(self, start: int, end: int) -> int:
        """Partners last met in [start, end); they are no longer kept."""
        gone = 0
        for ts, partners in self._slots(self._met, start, end):
            for t, partner in zip(ts, partners):
                if start <= t < end and self._partner.containsKey((partner,)) and self._partner.getValue((partner,))[0] == t:
                    self._partner.removeKey((partner,))
                    gone += 1
        return gone

    def _forget(self, states, end: int) -> None:
        """Slots that lie before ``end`` as a whole."""
        known = self._known[states]
        cut = bisect_left(known, end // SLOT_S)
        for slot in known[:cut]:
            states.removeKey((slot,))
        del known[:cut]

    def _meet(self, partner: str, ts: int) -> int:
        """1 if the partner was not active. A slot keeps the latest meeting of each partner only."""
        known = self._partner.containsKey((partner,))
        slot = ts // SLOT_S
        if known and self._partner.getValue((partner,))[0] // SLOT_S == slot:
            times, partners = map(list, self._met.getValue((slot,)))
            times[partners.index(partner)] = ts
            self._met.updateValue((slot,), (times, partners))
        else:
            self._append(self._met, ts, partner)
        self._partner.updateValue((partner,), (ts,))
        return 0 if known else 1

    def _append(self, states, ts: int, value) -> None:
        slot, known = ts // SLOT_S, self._known[states]
        if known and known[-1] == slot:
            times, values = map(list, states.getValue((slot,)))
        else:
            known.append(slot)
            times, values = [], []
        states.updateValue((slot,), (times + [ts], values + [value]))

    def close(self) -> None:
        pass


def stream_entity_features(
    stream: DataFrame,
    event_time: str = "event_time",
    lateness: str = "1 hour",
    cols: TxnColumns = TxnColumns(),
    kinds: tuple[str, ...] = (CARD, DEVICE),
) -> DataFrame:
    """Per entity (or pair) and second: what was known of it strictly before.

    ``stream`` has the columns of ``cols`` and a timestamp ``event_time`` of the same second
    as ``cols.ts``. ``joint`` counts earlier rows with a partner, ``active`` the distinct partners
    of the window. ``at`` carries the watermark on. The RocksDB state store must be set.
    """
    # The input's watermark has to survive the projection to entities.
    timed = stream.withWatermark(event_time, lateness)
    roles = {k: v for k, v in cols.roles().items() if k in kinds}
    others = {CARD: cols.device, DEVICE: cols.card, ADDRESS: cols.card}

    def text(name: str | None, missing: str | None):
        return F.col(name).cast("string") if name else F.lit(missing).cast("string")

    entries = [
        F.struct(
            F.lit(kind).alias("kind"),
            text(key, None).alias("key"),
            text(partner, "").alias("partner"),
            text(others.get(kind), None).alias("other"),
        )
        for kind, (key, partner) in roles.items()
    ]
    angle = hour_of(F.col(cols.ts)) * F.lit(2 * math.pi / 24)
    rows = timed.select(
        F.col(event_time).alias("event_time"),
        F.col(cols.amount).cast("double").alias("amount"),
        F.cos(angle).alias("x"),
        F.sin(angle).alias("y"),
        F.col(cols.ts).cast("long").alias("ts"),
        F.inline(F.array(*entries)),
    ).filter(F.col("key").isNotNull() & F.col("partner").isNotNull())
    seconds = rows.groupBy(F.window("event_time", "1 second"), "kind", "key", "partner", "other").agg(
        F.max("ts").alias("ts"),
        F.count("*").alias("rows"),
        F.count("amount").alias("amounts"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"),
        F.coalesce(F.var_pop("amount") * F.count("amount"), F.lit(0.0)).alias("inner"),
        F.sum("x").alias("east"),
        F.sum("y").alias("north"),
    )
    steps = seconds.withColumn("at", F.window_time("window")).drop("window").withColumn("at_ms", F.unix_millis("at"))
    return (
        steps.groupBy("kind", "key", "partner")
        .transformWithStateInPandas(EntityHistory(), OUTPUT, "Append", "EventTime", eventTimeColumnName="at")
    )


def stream_relational_features(
    stream: DataFrame,
    event_time: str = "event_time",
    lateness: str = "1 hour",
    cols: TxnColumns = TxnColumns(),
    min_amount_history: int = 2,
) -> DataFrame:
    """The 16 relational features of each row of a stream, told once the watermark has passed it.

    Equal to ``relational_features`` with strict ties for all rows within the lateness. The states of
    entities and pairs are joined back to the rows by key and second, and folded to one row each.
    """
    kinds = (CARD, DEVICE, ADDRESS, DEVICE_CARD, ADDRESS_CARD)
    states = stream_entity_features(stream, event_time, lateness, cols, kinds).select(
        *[F.col(c).alias(f"of_{c}") for c in ("kind", "key", "partner", "ts")],
        "at", "seen", "last_ts", "known", "mean", "squares", "east", "north", "in_1h", "in_24h", "joint", "active",
    )
    timed = stream.withWatermark(event_time, lateness)
    obs = observations(timed, cols, kinds, keep=(event_time,)).select("row_id", "ts", "amount", "kind", "key", "partner", event_time)
    same = [F.col(c) == F.col(f"of_{c}") for c in ("kind", "key", "partner", "ts")]
    near = F.col("at").between(F.col(event_time) - F.expr("interval 1 second"), F.col(event_time) + F.expr("interval 1 second"))
    joined = obs.filter(F.col("kind") != NOTHING).join(states, [*same, near], "inner")
    known = [c for c in states.columns if not c.startswith("of_") and c != "at"]
    alone = obs.filter(F.col("kind") == NOTHING)
    rows = joined.select(*obs.columns, *known).unionByName(alone, allowMissingColumns=True)
    by = [F.window(event_time, "1 second").alias("second"), F.col("row_id")]
    made = fold_relational(rows, by, min_amount_history)
    return made.drop("second").withColumnRenamed("row_id", cols.row_id)
