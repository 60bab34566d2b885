"""Status of cases from a stream of requested actions that may arrive out of order.

Actions wait in a buffer until the watermark has passed their event time; event-time timers
release them then, those of one time in order of ``seq``. So an order of arrival that stays
within the lateness gives what ``replay_actions`` gives for the whole log. An action whose
``seq`` is not above the last released one comes too late: it changes nothing and is told with
the reason ``late``, next to the number of late actions of its case.

The event time is handed on as a plain number, because Spark would drop rows behind the
watermark before they could be told.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ledgerlens.operators.cases import DECIDABLE, DECISIONS, STATUSES, TRANSITIONS

LATE = "late"

OUTPUT = StructType(
    [
        StructField("case_id", LongType()),
        StructField("seq", LongType()),
        StructField("action", StringType()),
        StructField("target", StringType()),
        StructField("status_before", StringType()),
        StructField("accepted", BooleanType()),
        StructField("reason", StringType()),
        StructField("status_after", StringType()),
        StructField("late_actions", LongType()),
    ]
)

_CASE = StructType([StructField("status", StringType()), StructField("last_seq", LongType()), StructField("late", LongType())])
_PLACE = StructType([StructField("at", LongType()), StructField("seq", LongType()), StructField("number", LongType())])
_ACTION = StructType(
    [StructField("action", StringType()), StructField("target", StringType()), StructField("acceptable", BooleanType())]
)


def refusal(status: str, action: str, target: str | None, acceptable: bool | None) -> str | None:
    """Why the action is refused in this status, or None if it is accepted."""
    if action == "NOTE":
        return None
    known = target is not None
    if action == "STATUS" and known and target not in STATUSES:
        return "unknown_status"
    if action == "STATUS" and target in DECISIONS:
        return "decision_required"
    if action == "DECISION" and known and target not in DECISIONS:
        return "unknown_decision"
    if acceptable is False:
        return "bad_reference"
    if action == "STATUS" and target == status:
        return "same_status"
    if action == "STATUS" and target not in TRANSITIONS[status]:
        return "illegal_transition"
    if action == "DECISION" and status not in DECIDABLE:
        return "not_decidable"
    return None


def next_status(current: str, action: str, target: str | None, acceptable: bool | None) -> tuple[bool, str]:
    """Is the action accepted, and the status afterwards."""
    accepted = refusal(current, action, target, acceptable) is None
    return accepted, target if accepted and action in ("STATUS", "DECISION") else current


class CaseMachine(StatefulProcessor):
    """State of one case: its status, the last released ``seq``, and the actions that wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._case = handle.getValueState("case", _CASE)
        self._waiting = handle.getMapState("waiting", _PLACE, _ACTION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken = {place for place in self._waiting.keys()}
        for frame in rows:
            for row in frame.itertuples(index=False):
                place = (int(row.at), int(row.seq), 0)
                while place in taken:  # a repeated row
                    place = (*place[:2], place[2] + 1)
                taken.add(place)
                acceptable = None if pd.isna(row.acceptable) else bool(row.acceptable)
                self._waiting.updateValue(place, (row.action, row.target, acceptable))
        yield self._release(key, timerValues.getCurrentWatermarkInMs())
        known = set(self._handle.listTimers())
        for at in {place[0] for place in self._waiting.keys()} - known:
            self._handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers end in order of time, one batch before the watermark shown here reaches them.
        yield self._release(key, expiredTimerInfo.getExpiryTimeInMs() + 1)

    def _release(self, key, passed: int) -> pd.DataFrame:
        """Everything before ``passed``, in order of ``seq``."""
        waiting = sorted(((tuple(k), tuple(v)) for k, v in self._waiting.iterator()), key=lambda e: (e[0][1], e[0][0], e[0][2]))
        status, last_seq, late = self._case.get() if self._case.exists() else ("NEW", None, 0)
        out = []
        for place, (action, target, acceptable) in waiting:
            at, seq, _ = place
            if at >= passed:
                continue
            self._waiting.removeKey(place)
            before = status
            if last_seq is not None and seq <= last_seq:
                late, reason = late + 1, LATE
            else:
                last_seq, reason = seq, refusal(status, action, target, acceptable)
                _, status = next_status(status, action, target, acceptable)
            out.append((key[0], seq, action, target, before, reason is None, reason, status, late))
        if out:
            self._case.update((status, last_seq, late))
        return pd.DataFrame(out, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def stream_case_status(actions: DataFrame, event_time: str = "event_time", lateness: str = "1 hour") -> DataFrame:
    """Outcome of each action of a stream (case_id, seq, action, target, acceptable, event time).

    Event times do not fall with ``seq`` within a case. An action is told once the watermark
    has passed its time. The RocksDB state store must be set.
    """
    timed = actions.withWatermark(event_time, lateness).select(
        "case_id", F.unix_millis(F.col(event_time).cast("timestamp")).alias("at"), "seq", "action", "target", "acceptable"
    )
    return timed.groupBy("case_id").transformWithStateInPandas(CaseMachine(), OUTPUT, "Append", "EventTime")
