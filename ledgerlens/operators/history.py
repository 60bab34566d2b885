"""Per-entity history features that only use earlier rows.

Every feature of a row at second t is derived from rows at seconds before t
(``ties="strict"``). ``ties="row_order"`` lets deviation, hour, recency and the
"never seen jointly" test also use rows of the same second that come earlier by row
id; counts of pairs and of rows in a time window stay strict.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import DAY_S, HOUR_S, hour_of
from ledgerlens.operators.running import prior_totals, steps_of, time_slot
from ledgerlens.operators.spread import HOT_ROWS, hot_keys

CARD, DEVICE, ADDRESS = "CARD", "DEVICE", "ADDRESS"
NOTHING = "NOTHING"
SUBJECTS = (CARD, DEVICE, ADDRESS)
DEVICE_CARD, ADDRESS_CARD, DEVICE_ADDRESS = "DEVICE_CARD", "ADDRESS_CARD", "DEVICE_ADDRESS"

# Windows in seconds, smallest deviation, shortest usable mean direction.
LONG_WINDOWS = {"1h": HOUR_S, "24h": DAY_S, "168h": 7 * DAY_S}
SHORT_WINDOWS = {"1h": HOUR_S, "24h": DAY_S}
ADDRESS_REACH_S = 7 * DAY_S
MIN_DEVIATION = 1e-3
MIN_RESULTANT = 1e-9

# The hash comes first because it sorts faster than the texts; the texts keep it exact.
ENTITY = ("entity", "kind", "key", "partner")
STRICT = ("_slot", "ts")
BY_ROW = ("_slot", "ts", "_bin", "row_id")
_BIN_ROWS = 100_000

# Slots of entities that are not hot: 48 days, at most 2^22 seconds.
LONG_SLOT_S = 1 << 22


@dataclass(frozen=True)
class TxnColumns:
    """Names of the input columns."""

    row_id: str = "transaction_id"
    ts: str = "ts"
    amount: str = "amount"
    card: str = "card_key"
    device: str = "device_key"
    address: str = "addr_key"

    def roles(self) -> dict[str, tuple[str, str | None]]:
        return {
            CARD: (self.card, None),
            DEVICE: (self.device, None),
            ADDRESS: (self.address, None),
            DEVICE_CARD: (self.device, self.card),
            ADDRESS_CARD: (self.address, self.card),
            DEVICE_ADDRESS: (self.device, self.address),
        }


def _entity() -> Column:
    return F.xxhash64("kind", "key", "partner")


def observations(txn: DataFrame, cols: TxnColumns, kinds: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per transaction and entity (or pair) it has; one row of kind NOTHING if it has none.

    ``keep`` names further columns to carry.
    """
    known = {*txn.columns}
    roles = {k: v for k, v in cols.roles().items() if k in kinds and {*v} - {None} <= known}

    def text(name: str | None) -> Column:
        return F.col(name).cast("string") if name else F.lit("")

    entries = [
        F.struct(F.lit(kind).alias("kind"), text(key).alias("key"), text(partner).alias("partner"))
        for kind, (key, partner) in roles.items()
    ]
    # Stands in for a transaction without any entity, so that it keeps its row.
    keyless = F.coalesce(*[F.concat(text(key), text(partner)) for key, partner in roles.values()]).isNull()
    entries.append(
        F.struct(
            F.lit(NOTHING).alias("kind"), F.when(keyless, F.lit("")).alias("key"), F.lit("").alias("partner")
        )
    )
    amount = F.col(cols.amount).cast("double") if cols.amount in known else F.lit(None).cast("double")
    ts = F.col(cols.ts).cast("long")
    return txn.select(
        F.col(cols.row_id).cast("long").alias("row_id"),
        ts.alias("ts"),
        time_slot(ts).alias("_slot"),
        F.floor(F.col(cols.row_id) / _BIN_ROWS).cast("long").alias("_bin"),
        amount.alias("amount"),
        *keep,
        F.inline(F.array(*entries)),
    ).filter(F.col("key").isNotNull() & F.col("partner").isNotNull()).withColumn("entity", _entity())


def _order(ties: str) -> tuple[str, ...]:
    if ties not in ("strict", "row_order"):
        raise ValueError("ties must be 'strict' or 'row_order'")
    return STRICT if ties == "strict" else BY_ROW


def _match(order: Sequence[str]) -> list[str]:
    return [ENTITY[0], *[c for c in order if c in ("ts", "row_id")], *ENTITY[1:]]


def entity_totals(
    obs: DataFrame,
    order: Sequence[str] = STRICT,
    windows: Mapping[str, Mapping[str, int]] | None = None,
) -> DataFrame:
    """What is known of each entity (or pair) before each of its steps.

    ``rows``, ``amounts``, ``total``, ``inner`` describe the step itself; ``seen``, ``last_ts``,
    ``east``/``north`` (mean hour as a direction), ``known`` and ``mean`` (earlier amounts)
    describe the steps before it. ``windows`` gives per kind the windows to count over:
    ``in_<name>`` is the number of rows in [t - W, t). A row raises that count right
    after its second and lowers it again W seconds later. Windows need the strict order.
    """
    windows = windows or {}
    names = list(dict.fromkeys(n for per_kind in windows.values() for n in per_kind))
    angle = hour_of(F.col("ts")) * F.lit(2 * math.pi / 24)
    kind = F.col("kind")
    if names:
        nothing = {c: F.lit(None).cast("double") for c in ("amount", "east", "north")}
        own = {"amount": F.col("amount"), "east": F.cos(angle), "north": F.sin(angle)}

        def change(at: Column, live: bool, flags: Mapping[str, Column]) -> Column:
            values = own if live else nothing
            return F.struct(
                at.alias("at"),
                F.lit(int(live)).alias("live"),
                *[v.alias(c) for c, v in values.items()],
                *[flags.get(n, F.lit(0)).cast("int").alias(n) for n in names],
            )

        def wanted(name: str) -> Column:
            return kind.isin(*[k for k, per_kind in windows.items() if name in per_kind])

        changes = [change(F.col("ts"), True, {n: wanted(n).cast("int") for n in names})]
        for name in names:
            length = F.coalesce(
                *[F.when(kind == k, F.lit(w[name])) for k, w in windows.items() if name in w]
            ).cast("long")
            changes.append(change(F.col("ts") + length, False, {name: F.lit(-1)}))
        due = obs.select(*ENTITY, F.inline(F.array(*changes))).filter(F.col("at").isNotNull())
        deltas = due.select(
            *ENTITY,
            F.col("at").alias("ts"),
            time_slot(F.col("at")).alias("_slot"),
            "live",
            "amount",
            "east",
            "north",
            *names,
        )
    else:
        deltas = obs.select(
            *ENTITY,
            *order,
            F.lit(1).alias("live"),
            "amount",
            F.cos(angle).alias("east"),
            F.sin(angle).alias("north"),
        )
    zero = F.lit(0.0)
    steps = steps_of(
        deltas,
        ENTITY,
        order,
        {
            "rows": F.sum("live"),
            "amounts": F.count("amount"),
            "total": F.coalesce(F.sum("amount"), zero),
            "inner": F.coalesce(F.var_pop("amount") * F.count("amount"), zero),
            "east": F.coalesce(F.sum("east"), zero),
            "north": F.coalesce(F.sum("north"), zero),
            "last": F.max(F.when(F.col("live") == 1, F.col("ts"))),
            **{n: F.sum(n) for n in names},
        },
    )
    totals = prior_totals(
        steps, ENTITY, order, sums=("rows", "amounts", "total", "east", "north", *names), maxes=("last",)
    )
    return totals.filter(F.col("rows") > 0).select(
        *ENTITY,
        *order,
        "rows",
        "amounts",
        "total",
        "inner",
        F.col("prior_rows").alias("seen"),
        F.col("prior_last").cast("long").alias("last_ts"),
        F.try_divide("prior_east", "prior_rows").alias("east"),
        F.try_divide("prior_north", "prior_rows").alias("north"),
        F.col("prior_amounts").alias("known"),
        F.try_divide("prior_total", "prior_amounts").alias("mean"),
        *[F.col(f"prior_{n}").alias(f"in_{n}") for n in names],
    )


@dataclass(frozen=True)
class PartnerWindow:
    """Count the distinct partners of one side of a pair kind over a window."""

    pair_kind: str
    subject: str
    window_s: int

    def key(self) -> Column:
        """The subject is the first or the second key of the pair."""
        return F.col("key") if self.pair_kind.startswith(self.subject) else F.col("partner")


def follow_up(
    totals: DataFrame,
    order: Sequence[str] = STRICT,
    spread: bool = True,
    partners: Sequence[PartnerWindow] = (),
) -> DataFrame:
    """Second pass over ``entity_totals``: spread of the earlier amounts and windowed partners.

    ``squares`` is the sum of squared deviations of the earlier amounts, built from the
    non-negative terms of the pairwise update of Chan, Golub and LeVeque, so equal amounts
    give exactly zero, however large.

    ``active`` is the number of distinct partners in [t - W, t) and ``joint`` the number
    of earlier joint rows. A joint row at t keeps its partner active up to t + W. What the
    previous joint row at p does not cover starts at max(t, p + W), so the stretches of
    one partner never overlap and the number of active partners is a running sum.
    """
    fields = []

    def entry(kind, key, at, squares=F.lit(0.0), active=F.lit(0), joint=F.lit(0), when=None):
        made = F.struct(
            kind.alias("of"),
            key.alias("of_key"),
            at.alias("at"),
            squares.alias("squares"),
            active.cast("long").alias("active"),
            joint.cast("long").alias("joint"),
        )
        fields.append(F.when(when, made))

    ts, single = F.col("ts"), F.col("partner") == ""
    if spread:
        before, here = F.col("known"), F.col("amounts")
        gap = F.try_divide("total", "amounts") - F.col("mean")
        added = F.when((before > 0) & (here > 0), gap * gap * before * here / (before + here))
        entry(F.col("kind"), F.col("key"), ts, F.col("inner") + F.coalesce(added, F.lit(0.0)), when=single)
    for w in partners:
        applies, subject = F.col("kind") == w.pair_kind, F.lit(w.subject)
        start = F.greatest(ts, F.col("last_ts") + F.lit(w.window_s))
        entry(subject, w.key(), ts, joint=F.col("rows"), when=applies)
        entry(subject, w.key(), start, active=F.lit(1), when=applies)
        entry(subject, w.key(), ts + F.lit(w.window_s), active=F.lit(-1), when=applies)
    carried = [c for c in order if c not in STRICT]
    due = totals.select(*carried, F.inline(F.array(*fields))).filter(F.col("of_key").isNotNull())
    deltas = due.select(
        F.col("of").alias("kind"),
        F.col("of_key").alias("key"),
        F.lit("").alias("partner"),
        F.col("at").alias("ts"),
        time_slot(F.col("at")).alias("_slot"),
        *carried,
        "squares",
        "active",
        "joint",
    ).withColumn("entity", _entity())
    names = ("squares", "active", "joint")
    steps = steps_of(deltas, ENTITY, order, {n: F.sum(n) for n in names})
    priors = prior_totals(steps, ENTITY, order, sums=names)
    return priors.select(*_match(order), *[F.col(f"prior_{n}").alias(n) for n in names])


def hour_distance(ts: Column, east: Column, north: Column) -> Column:
    """Circular distance (0 to 1) of the row's hour to a mean direction; NULL if that is undefined."""
    turn = F.abs(hour_of(ts) * F.lit(2 * math.pi / 24) - F.atan2(north, east))
    turn = F.pmod(turn, F.lit(2 * math.pi))
    near = F.least(turn, F.lit(2 * math.pi) - turn) / F.lit(math.pi)
    return F.when(F.sqrt(east * east + north * north) >= MIN_RESULTANT, near)


def _hour() -> Column:
    return hour_distance(F.col("ts"), F.col("east"), F.col("north"))


def _amount_z(min_history: int) -> Column:
    deviation = F.sqrt(F.try_divide("squares", "known"))
    z = (F.col("amount") - F.col("mean")) / F.greatest(deviation, F.lit(MIN_DEVIATION))
    return F.when(F.col("known") >= min_history, z)


def _recency() -> Column:
    return (F.col("ts") - F.col("last_ts")) / F.lit(float(HOUR_S))


def _of(kind: str, value: Column) -> Column:
    """Value of the one long row of this kind, used when folding back to one row per transaction."""
    return F.max(F.when(F.col("kind") == kind, value))


def relational_features(
    txn: DataFrame,
    cols: TxnColumns = TxnColumns(),
    min_amount_history: int = 2,
    ties: str = "strict",
    hot_rows: int = HOT_ROWS,
    slot_s: int = LONG_SLOT_S,
) -> DataFrame:
    """The 16 causal features, one row per transaction.

    Entities with at most ``hot_rows`` rows have long slots (``_settled``): a row is shuffled once per entity
    and once more to fold. Only the hot ones are cut into hours (``_by_hour``).
    """
    order = _order(ties)
    txn, hot = _flagged(txn, cols, hot_rows)
    known = {*txn.columns}
    others = [
        (F.col(name).cast("string") if name in known else F.lit(None).cast("string")).alias(f"_{kind}")
        for kind, name in ((CARD, cols.card), (DEVICE, cols.device))
    ]
    obs = observations(txn, cols, SUBJECTS, [*others, *hot.values()])
    settled = F.col("ts").isNotNull() & (F.col("kind") != NOTHING)
    bare = obs.filter(~settled).select("row_id", F.lit(NOTHING).alias("kind"), *[F.lit(None).cast("double").alias(c) for c in _MEASURES])
    is_hot = F.lit(False)
    for kind, flag in hot.items():
        is_hot = is_hot | ((F.col("kind") == kind) & flag)
    # In row order, rows without a time come before all others.
    taking_part = settled if order == STRICT else F.col("kind") != NOTHING
    cold = obs.filter(taking_part & ~is_hot).withColumn("other", F.when(F.col("kind") == CARD, F.col("_DEVICE")).otherwise(F.col("_CARD")))
    measured = _settled(cold, order, _span(txn, cols), slot_s, min_amount_history).unionByName(bare)
    if hot:
        measured = measured.unionByName(_by_hour(txn, cols, hot, order, min_amount_history))
    return _fold_measures(measured).withColumnRenamed("row_id", cols.row_id)


def _flagged(
    txn: DataFrame, cols: TxnColumns, hot_rows: int, kinds: Sequence[str] = SUBJECTS
) -> tuple[DataFrame, dict[str, Column]]:
    """``txn`` and, per kind that has entities of more than ``hot_rows`` rows, a flag for their rows."""
    named = observations(txn, cols, kinds).filter(F.col("kind") != NOTHING)
    counted = hot_keys(named, ["kind", "key"], hot_rows)
    found = counted.collect()  # a few per shuffle partition
    flags = {}
    for kind, (name, _) in cols.roles().items():
        keys = [(r["key"],) for r in found if r["kind"] == kind]
        if keys:
            flag = f"_hot_{kind}"
            known = txn.sparkSession.createDataFrame(keys, "_key string").withColumn(flag, F.lit(True))
            txn = txn.join(F.broadcast(known), F.col(name).cast("string") == F.col("_key"), "left").drop("_key")
            txn = txn.withColumn(flag, F.coalesce(flag, F.lit(False)))
            flags[kind] = F.col(flag)
    return txn, flags


def _span(txn: DataFrame, cols: TxnColumns) -> tuple[int, int]:
    """First and last second of the rows."""
    ts = F.col(cols.ts).cast("long")
    first, last = txn.agg(F.min(ts), F.max(ts)).first()
    return (0, 0) if first is None else (first, last)


def _settled(
    cold: DataFrame, order: Sequence[str], span: tuple[int, int], slot_s: int, min_amount_history: int
) -> DataFrame:
    """Measures of each row from its entity's rows, which lie together per slot of ``slot_s`` seconds.

    No entity here has more rows than a task takes. A row whose windows reach into the next slot
    has a copy there that is not ``live``: it stands for what is open when the slot begins and closes in it.
    So only the totals over all earlier rows need the slots before, if the rows span more than one.
    """
    first, last = span
    reach = F.when(F.col("kind") == ADDRESS, F.lit(ADDRESS_REACH_S)).otherwise(F.lit(DAY_S)).cast("long")
    if slot_s < ADDRESS_REACH_S:
        raise ValueError("a slot must be at least as long as the longest window")

    def slot(at: Column) -> Column:
        return time_slot(at - F.lit(first), slot_s)

    ts, at, live, prev = F.col("ts"), F.col("at"), F.col("live") == 1, F.col("prev")
    entity, place = ["entity", "kind", "key"], ["entity", "kind", "key", "_slot"]
    # Slots of the rows themselves: the windows below never hold more than one of an entity.
    rows = cold.select(*entity, "other", "ts", "row_id", "amount", reach.alias("reach"), F.coalesce(slot(ts), F.lit(0)).alias("_slot"), F.lit(1).alias("live"))
    several = last - first >= slot_s
    copies = rows
    if several:
        after = rows.filter(slot(ts + F.col("reach")) > F.col("_slot"))
        copies = rows.unionByName(after.withColumn("_slot", F.col("_slot") + 1).withColumn("live", F.lit(0)))
    copies = copies.repartition(*place)

    pair = Window.partitionBy(*place, "other").orderBy("ts")
    pair_before = pair.rangeBetween(Window.unboundedPreceding, -1)
    both = F.col("other").isNotNull()
    paired = copies.select(
        *copies.columns,
        F.coalesce(F.sum(F.when(ts.isNotNull(), F.col("live"))).over(pair_before), F.lit(0)).alias("met"),
        F.max("ts").over(pair_before).alias("prev"),
        # One of the joint rows of a second speaks for all of them.
        (both & (F.row_number().over(pair) == F.count("*").over(pair_before) + 1)).alias("speaks"),
    )
    speaks, until = F.col("speaks"), F.col("reach")
    counted_kind = F.col("kind") != ADDRESS
    here = F.col("_slot")

    def change(when, moment, is_live=0, one=F.lit(0), day=F.lit(0), act=F.lit(0)):
        return F.when(
            when,
            F.struct(
                moment.cast("long").alias("at"), F.lit(is_live).alias("alive"), one.cast("int").alias("one"),
                day.cast("int").alias("day"), act.cast("int").alias("act"),
            ),
        )

    covered = F.coalesce(prev + until > ts, F.lit(False))
    changes = [
        change(live, ts, 1, ts.isNotNull(), ts.isNotNull(), speaks & ~covered & ts.isNotNull()),
        change(counted_kind & (slot(ts + HOUR_S) == here), ts + HOUR_S, one=F.lit(-1)),
        change((counted_kind | speaks) & (slot(ts + until) == here), ts + until, day=F.lit(-1), act=-speaks.cast("int")),
        change(speaks & covered & (slot(prev + until) == here), prev + until, act=F.lit(1)),
    ]
    if several:
        begin = F.lit(first) + here * F.lit(slot_s) - 1
        changes.append(change(~live, begin, 0, slot(ts + HOUR_S) == here, F.lit(1), speaks & prev.isNull()))
    due = paired.select(
        *place, "other", "row_id", "amount", "met", F.inline(F.array(*changes))
    ).filter(F.col("alive").isNotNull())

    told = F.col("alive") == 1
    if order != STRICT:
        told = told & F.col("row_id").isNotNull()
    angle = hour_of(at) * F.lit(2 * math.pi / 24)
    state = Window.partitionBy(*place).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    if order != STRICT:
        # Rows of one second and id are put straight by ``_of_peers``; no other order, and no other sort, is needed.
        state = Window.partitionBy(*place).orderBy("at", "row_id").rowsBetween(Window.unboundedPreceding, -1)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(told, value)).over(state), F.lit(0)).cast("double")

    def open_now(name: str) -> Column:
        return F.coalesce(F.sum(name).over(state), F.lit(0)).cast("double").alias(name)

    known_here = F.count(F.when(told, F.col("amount"))).over(state)
    spread = F.coalesce(F.var_pop(F.when(told, F.col("amount"))).over(state), F.lit(0.0)) * known_here
    if order != STRICT:
        # Amounts without a time count for the mean, but their own spread does not.
        void = F.when(told & at.isNull(), F.col("amount"))
        void_spread = F.coalesce(F.var_pop(void).over(state), F.lit(0.0)) * F.count(void).over(state)
        spread = F.greatest(spread - void_spread, F.lit(0.0))
    local = due.select(
        *place,
        "other",
        "row_id",
        "amount",
        "alive",
        "at",
        F.col("met").cast("double").alias("met"),
        *[open_now(c) for c in ("one", "day", "act")],
        total(F.lit(1)).alias("rows"),
        total(both.cast("int")).alias("joint"),
        total(F.cos(angle)).alias("east"),
        total(F.sin(angle)).alias("north"),
        F.max(F.when(told, at)).over(state).alias("last_ts"),
        known_here.cast("double").alias("known"),
        total(F.col("amount")).alias("total"),
        spread.alias("squares"),
        *([] if order == STRICT else [F.count("*").over(state).alias("_nth")]),
    )
    if order != STRICT:
        local = _of_peers(local, place)
    names = {"at": "ts", "one": "in_1h", "day": "in_24h", "act": "active"}
    local = local.filter((F.col("alive") == 1) & at.isNotNull()).withColumnsRenamed(names)
    if several:
        local = _after_slots(local, rows if order == STRICT else rows.filter(F.col("row_id").isNotNull()), rows, entity)
    return _measures(
        local.select(
            "*",
            F.try_divide("total", "known").alias("mean"),
        ).withColumn("east", F.try_divide("east", "rows")).withColumn("north", F.try_divide("north", "rows")),
        F.when(both & (F.col("kind") != CARD), F.col("met")),
        min_amount_history,
    )


def _of_peers(local: DataFrame, place: Sequence[str]) -> DataFrame:
    """Running totals of rows in the order of second and id, made those before the row's second or second and id.

    What is open in a window is told by the first row of a second (column ``_nth``), the rest by the first row of a
    second and id. Both windows follow the order the rows have, and hold no more than the rows of one second.
    """
    windows = ("one", "day", "act")
    told = ("rows", "joint", "east", "north", "last_ts", "known", "total", "squares")
    second = [*place, "at"]
    packed = local.withColumns(
        {
            "_open": F.min_by(F.struct(*windows), "_nth").over(Window.partitionBy(*second)),
            "_told": F.min_by(F.struct(*told), "_nth").over(Window.partitionBy(*second, "row_id")),
        }
    )
    first = {**{c: F.col("_open")[c] for c in windows}, **{c: F.col("_told")[c] for c in told}}
    return packed.select(*[first.get(c, F.col(c)).alias(c) for c in local.columns if c != "_nth"])


def _after_slots(local: DataFrame, told: DataFrame, rows: DataFrame, entity: Sequence[str]) -> DataFrame:
    """``local`` with the totals of the slots before added."""
    angle = hour_of(F.col("ts")) * F.lit(2 * math.pi / 24)
    before = Window.partitionBy(*entity).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = ["rows", "joint", "east", "north", "known", "total"]
    void = F.when(F.col("ts").isNull(), F.col("amount"))
    per_slot = told.groupBy(*entity, "_slot").agg(
        F.count("*").alias("rows"),
        F.count("other").alias("joint"),
        F.sum(F.cos(angle)).alias("east"),
        F.sum(F.sin(angle)).alias("north"),
        F.count("amount").alias("known"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"),
        (
            F.coalesce(F.var_pop("amount") * F.count("amount"), F.lit(0.0))
            - F.coalesce(F.var_pop(void) * F.count(void), F.lit(0.0))
        ).alias("inner"),
        F.max("ts").alias("last_ts"),
    )
    held = per_slot.select(
        *entity, "_slot", "inner", *[F.col(c).alias(f"own_{c}") for c in ("known", "total")],
        *[F.sum(c).over(before).cast("double").alias(f"past_{c}") for c in sums],
        F.max("last_ts").over(before).alias("past_last_ts"),
    )
    held = held.withColumn("term", F.col("inner") + _between("past_known", "past_total", "own_known", "own_total"))
    held = held.withColumn("past_squares", F.sum("term").over(before)).filter("past_rows > 0")
    past = held.select(*entity, "_slot", "past_last_ts", "past_squares", *[f"past_{c}" for c in sums])
    pairs = rows.filter(F.col("other").isNotNull() & F.col("ts").isNotNull() & (F.col("kind") != CARD))
    pair_before = Window.partitionBy(*entity, "other").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    met = (
        pairs.groupBy(*entity, "other", "_slot").agg(F.count("*").alias("n"))
        .select(*entity, "other", "_slot", F.sum("n").over(pair_before).cast("double").alias("past_met"))
        .filter(F.col("past_met") > 0)
    )
    both = local.join(past, [*entity, "_slot"], "left").join(met, [*entity, "_slot", "other"], "left")
    zero = F.lit(0.0)
    added = {c: F.col(c) + F.coalesce(F.col(f"past_{c}"), zero) for c in (*sums, "met")}
    added["last_ts"] = F.coalesce("last_ts", "past_last_ts")
    added["squares"] = (
        F.col("squares") + F.coalesce("past_squares", zero) + _between("past_known", "past_total", "known", "total")
    )
    return both.select(*[added.get(c, F.col(c)).alias(c) for c in local.columns])


def _between(known: str, total: str, more: str, more_total: str) -> Column:
    """What joining two sets of amounts adds to their squared deviations (Chan, Golub and LeVeque)."""
    gap = F.try_divide(more_total, more) - F.try_divide(total, known)
    return F.coalesce(gap * gap * F.try_divide(F.col(known) * F.col(more), F.col(known) + F.col(more)), F.lit(0.0))


def _by_hour(
    txn: DataFrame, cols: TxnColumns, hot: Mapping[str, Column], order: Sequence[str], min_amount_history: int
) -> DataFrame:
    """Measures of the rows of hot entities, whose rows are combined per second and cut into hours."""
    never = F.lit(False)
    flags = {kind: hot.get(kind, never) for kind in SUBJECTS}
    wanted = {**flags, DEVICE_CARD: flags[DEVICE] | flags[CARD], ADDRESS_CARD: flags[ADDRESS]}
    picked = never
    for kind, flag in wanted.items():
        picked = picked | ((F.col("kind") == kind) & flag)
    obs = observations(txn, cols, tuple(wanted), list(hot.values())).filter(picked)
    used = obs.filter(F.col("kind").isin(CARD, DEVICE, DEVICE_CARD, ADDRESS_CARD))
    strict = entity_totals(used, STRICT, {CARD: SHORT_WINDOWS, DEVICE: SHORT_WINDOWS})
    partner_windows = (
        PartnerWindow(DEVICE_CARD, DEVICE, DAY_S),
        PartnerWindow(DEVICE_CARD, CARD, DAY_S),
        PartnerWindow(ADDRESS_CARD, ADDRESS, ADDRESS_REACH_S),
    )
    counts = ["in_1h", "in_24h"]
    state = ["last_ts", "east", "north", "known", "mean"]
    if order == STRICT:
        after = follow_up(strict, STRICT, True, partner_windows)
        rows = obs.join(strict.select(*_match(STRICT), "seen", *counts, *state), _match(STRICT), "left").join(
            after, _match(STRICT), "left"
        )
    else:
        own = entity_totals(obs.filter(F.col("kind").isin(CARD, DEVICE)), order)
        rows = (
            obs.join(strict.select(*_match(STRICT), "seen", *counts), _match(STRICT), "left")
            .join(
                follow_up(strict, STRICT, False, partner_windows).select(*_match(STRICT), "active"),
                _match(STRICT),
                "left",
            )
            .join(own.select(*_match(order), *state), _match(order), "left")
            .join(follow_up(own, order).select(*_match(order), "squares"), _match(order), "left")
            .join(_joint_rows_by_row(obs), _match(order), "left")
        )
    return _measures(rows, F.when(F.col("kind").isin(DEVICE_CARD, ADDRESS_CARD), F.col("seen")), min_amount_history)


# What is told of one row and one of its entities, to be folded by row.
_MEASURES = ("z", "hour", "recency", "in_1h", "in_24h", "partners", "met")


def _measures(rows: DataFrame, met: Column, min_amount_history: int) -> DataFrame:
    told = {
        "z": _amount_z(min_amount_history),
        "hour": _hour(),
        "recency": _recency(),
        "in_1h": F.col("in_1h"),
        "in_24h": F.col("in_24h"),
        "partners": F.when(F.col("joint") > 0, F.col("active")),
        "met": met,
    }
    return rows.select("row_id", "kind", *[told[c].cast("double").alias(c) for c in _MEASURES])


def _fold_measures(measured: DataFrame) -> DataFrame:
    """The 16 features by row; the rows are narrow, so they are shuffled before they are combined."""
    wide = (
        measured.repartition("row_id")
        .groupBy("row_id")
        .agg(
            *[
                _of(kind, F.col(c)).alias(name)
                for kind, names in (
                    (CARD, ("amt_z_card", "hour_dev_card", "hours_since_last_card", "card_tx_1h", "card_tx_24h", "_card_devs")),
                    (DEVICE, ("amt_z_device", "hour_dev_device", "hours_since_last_device", "dev_tx_1h", "dev_tx_24h", "_dev_cards")),
                )
                for c, name in zip(_MEASURES, names)
            ],
            _of(ADDRESS, F.col("partners")).alias("_addr_cards"),
            F.max(F.when(F.col("kind").isin(DEVICE, DEVICE_CARD), F.col("met"))).alias("_met_device"),
            F.max(F.when(F.col("kind").isin(ADDRESS, ADDRESS_CARD), F.col("met"))).alias("_met_addr"),
        )
    )
    return _features(wide)


def fold_relational(rows: DataFrame, by: Sequence[str | Column], min_amount_history: int = 2) -> DataFrame:
    """The 16 features from one row per transaction and entity (or pair) with what was known before.

    ``by`` makes one group per transaction; ``row_id`` and, of a stream, the window ``second``.
    """
    partners = F.when(F.col("joint") > 0, F.col("active"))
    wide = rows.groupBy(*by).agg(
        _of(CARD, _amount_z(min_amount_history)).alias("amt_z_card"),
        _of(DEVICE, _amount_z(min_amount_history)).alias("amt_z_device"),
        _of(CARD, _hour()).alias("hour_dev_card"),
        _of(DEVICE, _hour()).alias("hour_dev_device"),
        _of(CARD, _recency()).alias("hours_since_last_card"),
        _of(DEVICE, _recency()).alias("hours_since_last_device"),
        _of(DEVICE_CARD, F.col("seen")).alias("_met_device"),
        _of(ADDRESS_CARD, F.col("seen")).alias("_met_addr"),
        _of(CARD, F.col("in_1h")).alias("card_tx_1h"),
        _of(CARD, F.col("in_24h")).alias("card_tx_24h"),
        _of(DEVICE, F.col("in_1h")).alias("dev_tx_1h"),
        _of(DEVICE, F.col("in_24h")).alias("dev_tx_24h"),
        _of(DEVICE, partners).alias("_dev_cards"),
        _of(CARD, partners).alias("_card_devs"),
        _of(ADDRESS, partners).alias("_addr_cards"),
    )
    return _features(wide)


def _features(wide: DataFrame) -> DataFrame:
    """The named features from the folded columns."""
    with_device, with_addr = F.col("_met_device").isNotNull(), F.col("_met_addr").isNotNull()
    made = {
        "is_new_device_card_pair": (F.col("_met_device") == 0).cast("double"),
        "is_new_addr_card_pair": (F.col("_met_addr") == 0).cast("double"),
        "log_pair_count_device_card": F.log1p("_met_device"),
        "device_distinct_cards_24h": F.when(with_device, F.col("_dev_cards")),
        "card_distinct_devices_24h": F.when(with_device, F.col("_card_devs")),
        "addr_distinct_cards_7d": F.when(with_addr, F.col("_addr_cards")),
    }
    return wide.select(
        *[c for c in wide.columns if c in ("second", "row_id")],
        *[made.get(name, F.col(name)).cast("double").alias(name) for name in RELATIONAL_FEATURES],
    )


# Names and order of the feature columns.
RELATIONAL_FEATURES = (
    "amt_z_card",
    "amt_z_device",
    "hour_dev_card",
    "hour_dev_device",
    "hours_since_last_card",
    "hours_since_last_device",
    "is_new_device_card_pair",
    "is_new_addr_card_pair",
    "log_pair_count_device_card",
    "card_tx_1h",
    "card_tx_24h",
    "dev_tx_1h",
    "dev_tx_24h",
    "device_distinct_cards_24h",
    "card_distinct_devices_24h",
    "addr_distinct_cards_7d",
)


def _joint_rows_by_row(obs: DataFrame) -> DataFrame:
    """Earlier joint rows of each subject when rows of one second are told apart by id."""
    sides = [
        F.when(
            F.col("kind") == pair,
            F.struct(F.lit(subject).alias("of"), PartnerWindow(pair, subject, 0).key().alias("of_key")),
        )
        for pair, subject in ((DEVICE_CARD, DEVICE), (DEVICE_CARD, CARD), (ADDRESS_CARD, ADDRESS))
    ]
    joint = obs.select(*BY_ROW, F.inline(F.array(*sides))).filter(F.col("of_key").isNotNull()).select(
        F.col("of").alias("kind"), F.col("of_key").alias("key"), F.lit("").alias("partner"), *BY_ROW
    ).withColumn("entity", _entity())
    steps = steps_of(joint, ENTITY, BY_ROW, {"joint": F.count("*")})
    totals = prior_totals(steps, ENTITY, BY_ROW, sums=("joint",))
    return totals.select(*_match(BY_ROW), F.col("prior_joint").alias("joint"))


def cumulative_history(
    txn: DataFrame,
    blocks: Mapping[str, tuple[str, Mapping[str, int]]],
    cols: TxnColumns = TxnColumns(),
    ties: str = "strict",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Earlier rows, rows per window, hours since the last row and mean earlier amount.

    ``blocks`` maps an entity kind to its column prefix and windows. Strict rows of an entity of at most
    ``hot_rows`` rows are shuffled once to lie together and once more, narrow, to fold by row; the others
    are cut into hours (``entity_totals``).
    """
    order = _order(ties)
    windows = {kind: per_kind for kind, (_, per_kind) in blocks.items()}
    names = list(dict.fromkeys(n for per_kind in windows.values() for n in per_kind))
    if ties == "strict" and names:
        txn, hot = _flagged(txn, cols, hot_rows, tuple(blocks))
        obs = observations(txn, cols, tuple(blocks), list(hot.values()))
        counted = (F.col("kind") != NOTHING) & F.col("ts").isNotNull()
        is_hot = _is_hot(hot)
        rows = _cumulated(obs.filter(counted & ~is_hot), windows, names).unionByName(
            obs.filter(~counted).select("row_id", F.lit(NOTHING).alias("kind")), allowMissingColumns=True
        )
        if hot:
            busy = obs.filter(counted & is_hot)
            totals = entity_totals(busy, STRICT, windows).select(*_match(STRICT), "seen", "last_ts", "mean", *[f"in_{n}" for n in names])
            rows = rows.unionByName(
                busy.join(totals, _match(STRICT), "left").select(
                    "row_id", "kind", "seen", *[f"in_{n}" for n in names], _recency().alias("recency"), "mean"
                )
            )
        rows = rows.repartition("row_id")
    else:
        obs = observations(txn, cols, tuple(blocks))
        own = obs.filter(F.col("kind") != NOTHING)
        strict = entity_totals(own, STRICT, windows)
        rows = obs.join(strict.select(*_match(STRICT), *[f"in_{n}" for n in names]), _match(STRICT), "left").join(
            entity_totals(own, order).select(*_match(order), "seen", "last_ts", "mean"), _match(order), "left"
        ).withColumn("recency", _recency())
    columns = []
    for kind, (prefix, per_kind) in blocks.items():
        columns.append(_of(kind, F.col("seen")).alias(f"{prefix}_tx_prior"))
        columns += [_of(kind, F.col(f"in_{n}")).alias(f"{prefix}_tx_prior_{n}") for n in per_kind]
        columns.append(_of(kind, F.col("recency")).alias(f"{prefix}_hours_since_last"))
        columns.append(_of(kind, F.col("mean")).alias(f"{prefix}_amt_prior_mean"))
    return rows.groupBy("row_id").agg(*columns).withColumnRenamed("row_id", cols.row_id)


def _is_hot(hot: Mapping[str, Column]) -> Column:
    """Whether a row belongs to a hot entity of its kind."""
    is_hot = F.lit(False)
    for kind, flag in hot.items():
        is_hot = is_hot | ((F.col("kind") == kind) & flag)
    return is_hot


def _cumulated(cold: DataFrame, windows: Mapping[str, Mapping[str, int]], names: Sequence[str]) -> DataFrame:
    """What is known before each row of entities whose rows lie together in one task."""
    entity, kind, ts = ["entity", "kind", "key"], F.col("kind"), F.col("ts")

    def change(at: Column, live: int, flags: Mapping[str, Column], when: Column | None = None) -> Column:
        made = F.struct(
            at.alias("at"), F.lit(live).alias("live"), *[flags.get(n, F.lit(0)).cast("int").alias(n) for n in names]
        )
        return made if when is None else F.when(when, made)

    def has(name: str) -> Column:
        return kind.isin(*[k for k, per_kind in windows.items() if name in per_kind])

    changes = [change(ts, 1, {n: has(n) for n in names})]
    for name in names:
        length = F.coalesce(*[F.when(kind == k, F.lit(w[name])) for k, w in windows.items() if name in w]).cast("long")
        changes.append(change(ts + length, 0, {name: F.lit(-1)}, has(name)))
    due = (
        cold.select(*entity, "row_id", "ts", "amount")
        .repartition(*entity)
        .select(*entity, "row_id", "amount", F.inline(F.array(*changes)))
        .filter(F.col("at").isNotNull())
    )
    live = F.col("live") == 1
    earlier = Window.partitionBy(*entity).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    amount = F.when(live, F.col("amount"))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0)).cast("double")

    state = due.select(
        "row_id",
        "kind",
        "live",
        F.col("at").alias("ts"),
        total("live").alias("seen"),
        *[total(n).alias(f"in_{n}") for n in names],
        F.max(F.when(live, F.col("at"))).over(earlier).alias("last_ts"),
        F.try_divide(F.sum(amount).over(earlier), F.count(amount).over(earlier)).alias("mean"),
    )
    return state.filter(live).select(
        "row_id", "kind", "seen", *[f"in_{n}" for n in names], _recency().alias("recency"), "mean"
    )


def _fresh_partners(
    cold: DataFrame, sides: Mapping[str, Sequence[tuple[str, str]]], outputs: Sequence[str]
) -> DataFrame:
    """Distinct partners before each row of subjects whose rows lie together in one task.

    ``sides`` names per subject kind the partner column (``o0``, ``o1``, ...) of each of its outputs.
    """
    entity = ["entity", "kind", "key"]
    width = max(len(s) for s in sides.values())
    partners = [f"o{i}" for i in range(width)]
    marked = cold.select(*entity, "row_id", "ts", *partners).repartition(*entity)
    for o in partners:
        first = F.row_number().over(Window.partitionBy(*entity, o).orderBy("ts")) == 1
        # A partner met in a row without a time, which comes first, is never new to a later row.
        marked = marked.withColumn(f"fresh_{o}", (F.col(o).isNotNull() & F.col("ts").isNotNull() & first).cast("int"))
    earlier = Window.partitionBy(*entity).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    counts = marked.select(
        "row_id", "kind", "ts",
        *[F.when(F.col(o).isNotNull(), F.coalesce(F.sum(f"fresh_{o}").over(earlier), F.lit(0)).cast("double")).alias(o) for o in partners],
    ).filter(F.col("ts").isNotNull())
    made = {
        name: F.when(F.col("kind") == kind, F.col(f"o{i}"))
        for kind, named in sides.items() for i, (name, _) in enumerate(named)
    }
    return counts.select("row_id", *[made.get(n, F.lit(None)).cast("double").alias(n) for n in outputs])


def _with_partners(obs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of pairs with the earlier distinct partners of their first (``_a``) and second key (``_b``)."""
    met = entity_totals(obs.filter(F.col("kind") != NOTHING), order)
    sides = F.array(
        F.struct(F.lit("first").alias("side"), F.col("key").alias("of_key")),
        F.struct(F.lit("second").alias("side"), F.col("partner").alias("of_key")),
    )
    fresh = (F.col("seen") == 0).cast("int").alias("fresh")
    arrivals = met.select("kind", *order, fresh, F.inline(sides)).withColumn(
        "subject", F.xxhash64("kind", "side", "of_key")
    )
    subject = ["subject", "kind", "side", "of_key"]
    steps = steps_of(arrivals, subject, order, {"fresh": F.sum("fresh")})
    totals = prior_totals(steps, subject, order, sums=("fresh",))
    at = [c for c in order if c in ("ts", "row_id")]
    rows = obs
    for side, key, name in (("first", "key", "_a"), ("second", "partner", "_b")):
        known = totals.filter(F.col("side") == side).select(
            "kind", F.col("of_key").alias(key), *at, F.col("prior_fresh").alias(name)
        )
        rows = rows.join(known, [*at, key, "kind"], "left")
    return rows


def _partners_at_once(
    txn: DataFrame, pairs: Mapping[str, tuple[str, str]], cols: TxnColumns, hot_rows: int
) -> DataFrame:
    """``cumulative_partners`` of strict rows."""
    roles = {k: cols.roles()[k] for k in pairs if {*cols.roles()[k]} <= {*txn.columns}}
    subjects = {key: kind for kind, (key, partner) in cols.roles().items() if partner is None}
    outputs, sides, of_pair = [], {}, {}
    for pair, (one, two) in pairs.items():
        of_pair[pair] = (f"{one}_distinct_{two}_prior", f"{two}_distinct_{one}_prior")
        outputs += of_pair[pair]
    for pair, (a, b) in roles.items():
        sides.setdefault(subjects[a], []).append((of_pair[pair][0], b))
        sides.setdefault(subjects[b], []).append((of_pair[pair][1], a))
    txn, hot = _flagged(txn, cols, hot_rows, tuple(sides))
    ts, row_id = F.col(cols.ts).cast("long"), F.col(cols.row_id).cast("long")
    width = max(len(s) for s in sides.values())
    entries = []
    for name, kind in subjects.items():
        if kind in sides:
            others = [F.col(other).cast("string") for _, other in sides[kind]]
            others += [F.lit(None).cast("string")] * (width - len(others))
            entry = F.struct(
                F.lit(kind).alias("kind"), F.col(name).cast("string").alias("key"),
                *[o.alias(f"o{i}") for i, o in enumerate(others)],
            )
            met = F.col(name).isNotNull() & F.coalesce(*others).isNotNull() & ~hot.get(kind, F.lit(False))
            entries.append(F.when(met, entry))
    cold = (
        txn.select(row_id.alias("row_id"), ts.alias("ts"), F.inline(F.array(*entries)))
        .filter(F.col("kind").isNotNull())
        .withColumn("entity", F.xxhash64("kind", "key"))
    )
    # A row without any pair or time keeps its place in the result.
    bare = txn.filter(ts.isNull() | F.coalesce(*entries).isNull()).select(row_id.alias("row_id"))
    rows = _fresh_partners(cold, sides, outputs).unionByName(bare, allowMissingColumns=True)
    if hot:
        obs = observations(txn, cols, tuple(roles), list(hot.values())).filter(F.col("kind") != NOTHING)
        busy = F.lit(False)
        made = {}
        for pair, (a, b) in roles.items():
            for name, count, key in zip(of_pair[pair], ("_a", "_b"), (a, b)):
                mine = (F.col("kind") == pair) & hot.get(subjects[key], F.lit(False))
                busy = busy | mine
                made[name] = F.when(mine, F.col(count))
        counted = _with_partners(obs.filter(busy), STRICT)
        rows = rows.unionByName(
            counted.select("row_id", *[made[n].cast("double").alias(n) for n in outputs if n in made]), allowMissingColumns=True
        )
    folded = rows.repartition("row_id").groupBy("row_id").agg(*[F.max(n).alias(n) for n in outputs])
    return folded.withColumnRenamed("row_id", cols.row_id)


def cumulative_partners(
    txn: DataFrame,
    pairs: Mapping[str, tuple[str, str]],
    cols: TxnColumns = TxnColumns(),
    ties: str = "strict",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Distinct partners so far in both directions; NULL when a key of the pair is missing.

    ``pairs`` maps a pair kind to the short names of its two sides. Strict rows of a subject of at most
    ``hot_rows`` rows lie together in one task, those of others are cut into hours.
    """
    order = _order(ties)
    if ties == "strict":
        return _partners_at_once(txn, pairs, cols, hot_rows)
    obs = observations(txn, cols, tuple(pairs))
    rows = _with_partners(obs, order)
    columns = []
    for kind, (one, two) in pairs.items():
        columns.append(_of(kind, F.col("_a")).alias(f"{one}_distinct_{two}_prior"))
        columns.append(_of(kind, F.col("_b")).alias(f"{two}_distinct_{one}_prior"))
    return rows.groupBy("row_id").agg(*columns).withColumnRenamed("row_id", cols.row_id)


def history_block(
    full: DataFrame, enriched: DataFrame, cols: TxnColumns = TxnColumns(), ties: str = "strict"
) -> DataFrame:
    """Cumulative features of the enriched rows.

    Card and address history runs over all transactions, device and pair history over
    the enriched rows only, because devices are known only there.
    """
    over_all = {CARD: ("card", LONG_WINDOWS), ADDRESS: ("addr", SHORT_WINDOWS)}
    pairs = {DEVICE_CARD: ("dev", "card"), DEVICE_ADDRESS: ("dev", "addr"), ADDRESS_CARD: ("addr", "card")}
    device = F.col(cols.device).isNotNull().cast("int").alias("has_device")
    addr = F.col(cols.address).isNotNull().cast("int").alias("has_addr")
    return (
        enriched.select(cols.row_id, device, addr)
        .join(cumulative_history(full, over_all, cols, ties), cols.row_id, "left")
        .join(
            cumulative_history(enriched, {DEVICE: ("dev", SHORT_WINDOWS)}, cols, ties), cols.row_id, "left"
        )
        .join(cumulative_partners(enriched, pairs, cols, ties), cols.row_id, "left")
    )


def deviation_block(
    full: DataFrame,
    enriched: DataFrame,
    cols: TxnColumns = TxnColumns(),
    ties: str = "strict",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Deviation from the entity's own history; a z-score needs one earlier amount only.

    The card columns use all transactions, the others the enriched rows. Strict rows of an entity of at most
    ``hot_rows`` rows are shuffled once to lie together and once more, narrow, to fold by row; the others
    are cut into hours (``entity_totals``).
    """
    order = _order(ties)
    others = (DEVICE, DEVICE_CARD, ADDRESS_CARD)
    if ties == "strict":
        card_rows = _deviated(full, cols, (CARD,), hot_rows).filter(F.col("kind") == CARD)
        rows = _deviated(enriched, cols, others, hot_rows).repartition("row_id")
    else:
        cards = observations(full, cols, (CARD,)).filter(F.col("kind") != NOTHING)
        strict_cards = entity_totals(cards, STRICT, {CARD: {"24h": DAY_S}})
        card_rows = _with_state(cards, entity_totals(cards, order), order).join(
            strict_cards.select(*_match(STRICT), "in_24h"), _match(STRICT), "left"
        )
        obs = observations(enriched, cols, others)
        rows = _with_state(obs, entity_totals(obs.filter(F.col("kind") != NOTHING), order), order)
        card_rows, rows = _deviations(card_rows), _deviations(rows.withColumn("in_24h", F.lit(None).cast("double")))
    card_columns = card_rows.select(
        F.col("row_id").alias(cols.row_id),
        F.col("z").alias("card_amt_z"),
        F.col("hour").alias("card_hour_dev"),
        F.col("burst").alias("card_burst_24h"),
    )
    device_columns = (
        rows.groupBy("row_id")
        .agg(
            _of(DEVICE, F.col("z")).alias("dev_amt_z"),
            _of(DEVICE, F.col("hour")).alias("dev_hour_dev"),
            _of(DEVICE_CARD, F.log1p("seen")).alias("pair_new_dev_card"),
            _of(ADDRESS_CARD, F.log1p("seen")).alias("pair_new_addr_card"),
        )
        .withColumnRenamed("row_id", cols.row_id)
    )
    return device_columns.join(card_columns, cols.row_id, "left").select(
        cols.row_id,
        "card_amt_z",
        "card_hour_dev",
        "card_burst_24h",
        "dev_amt_z",
        "dev_hour_dev",
        "pair_new_dev_card",
        "pair_new_addr_card",
    )


def _with_state(obs: DataFrame, totals: DataFrame, order: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``obs`` with what ``entity_totals`` and ``follow_up`` tell of the steps before."""
    state = ["seen", "east", "north", "known", "mean"]
    return obs.join(totals.select(*_match(order), *state, *extra), _match(order), "left").join(
        follow_up(totals, order).select(*_match(order), "squares"), _match(order), "left"
    )


def _deviations(rows: DataFrame) -> DataFrame:
    burst = F.try_divide(F.col("in_24h"), F.sqrt("seen"))
    told = {"z": _amount_z(1), "hour": _hour(), "burst": burst, "seen": F.col("seen")}
    return rows.select("row_id", "kind", *[v.cast("double").alias(c) for c, v in told.items()])


def _deviated(txn: DataFrame, cols: TxnColumns, kinds: Sequence[str], hot_rows: int) -> DataFrame:
    """``z``, ``hour``, ``burst`` and ``seen`` of each strict row and entity (or pair) of ``kinds``.

    A row without a time has none of them. It comes before all others, but not where rows per window are counted.
    """
    txn, hot = _flagged(txn, cols, hot_rows, kinds)
    obs = observations(txn, cols, kinds, list(hot.values()))
    timed = F.col("ts").isNotNull()
    named, is_hot = F.col("kind") != NOTHING, _is_hot(hot)
    windowed = F.col("kind") == CARD
    rows = _deviations(_states(obs.filter(named & ~is_hot & (timed | ~windowed)), windowed)).unionByName(
        obs.filter(~named | (~timed & ~is_hot)).select("row_id", "kind"), allowMissingColumns=True
    )
    if hot:
        busy = obs.filter(named & is_hot)
        if CARD in kinds:
            totals, extra = entity_totals(busy, STRICT, {CARD: {"24h": DAY_S}}), ["in_24h"]
            state = _with_state(busy, totals, STRICT, extra)
        else:
            state = _with_state(busy, entity_totals(busy, STRICT), STRICT).withColumn("in_24h", F.lit(None).cast("double"))
        rows = rows.unionByName(_deviations(state))
    return rows


def _states(cold: DataFrame, windowed: Column) -> DataFrame:
    """What is known before each row of entities (or pairs) whose rows lie together in one task."""

    def change(at: Column, live: int, day: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(live).alias("live"), day.cast("int").alias("day"))

    closing = F.when(windowed, change(F.col("ts") + F.lit(DAY_S), 0, F.lit(-1)))
    due = (
        cold.select(*ENTITY, "row_id", "ts", "amount")
        .repartition(*ENTITY)
        .select(*ENTITY, "row_id", "amount", F.inline(F.array(change(F.col("ts"), 1, windowed), closing)))
        .filter(F.col("live").isNotNull())
    )
    at, live = F.col("at"), F.col("live") == 1
    angle = hour_of(at) * F.lit(2 * math.pi / 24)
    earlier = Window.partitionBy(*ENTITY).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    amount = F.when(live, F.col("amount"))
    # Amounts without a time count for the mean, but their own spread does not.
    void = F.when(live & at.isNull(), F.col("amount"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("double")

    def spread(value: Column) -> Column:
        return F.coalesce(F.var_pop(value).over(earlier), F.lit(0.0)) * F.count(value).over(earlier)

    seen, known = total(F.col("live")), F.count(amount).over(earlier).cast("double")
    return due.select(
        "row_id",
        "kind",
        "amount",
        "live",
        at.alias("ts"),
        seen.alias("seen"),
        total(F.col("day")).alias("in_24h"),
        F.try_divide(total(F.when(live, F.cos(angle))), seen).alias("east"),
        F.try_divide(total(F.when(live, F.sin(angle))), seen).alias("north"),
        known.alias("known"),
        F.try_divide(F.sum(amount).over(earlier), known).alias("mean"),
        F.greatest(spread(amount) - spread(void), F.lit(0.0)).alias("squares"),
    ).filter(live & F.col("ts").isNotNull())
