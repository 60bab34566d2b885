"""Investigation cases as an analysis of a log of requested actions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.running import id_levels, prior_totals
from ledgerlens.operators.spread import spread_join
from ledgerlens.session import cut_lineage

# Statuses and the statuses each may move to.
TRANSITIONS = {
    "NEW": ("INVESTIGATING", "ESCALATED"),
    "INVESTIGATING": ("ESCALATED", "CONFIRMED_FRAUD", "FALSE_POSITIVE"),
    "ESCALATED": ("INVESTIGATING", "CONFIRMED_FRAUD", "FALSE_POSITIVE"),
    "CONFIRMED_FRAUD": ("CLOSED",),
    "FALSE_POSITIVE": ("CLOSED",),
    "CLOSED": (),
}
STATUSES = tuple(TRANSITIONS)
DECISIONS = ("CONFIRMED_FRAUD", "FALSE_POSITIVE")
DECIDABLE = ("INVESTIGATING", "ESCALATED")
LABEL_VALUES = {"CONFIRMED_FRAUD": 1, "FALSE_POSITIVE": 0}

# Actions of one case are folded in blocks of this many, and blocks in blocks of blocks.
BLOCK = 100


def _index(status: Column) -> Column:
    """Position of a status in STATUSES, NULL if unknown."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(STATUSES):
        out = F.when(status == name, F.lit(i)).otherwise(out)
    return out


def _name(index: Column) -> Column:
    named = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), index.cast("int") + 1)
    return F.when(index.isNotNull(), named)


def can_move(previous: Column, following: Column) -> Column:
    legal = F.lit(False)
    for origin, targets in TRANSITIONS.items():
        if targets:
            legal = legal | ((previous == origin) & following.isin(*targets))
    return F.coalesce(legal, F.lit(False))


def validate_transitions(history: DataFrame) -> DataFrame:
    """Each recorded status step (case_id, seq, status) with its predecessor and whether it is legal.

    The predecessor is found as a running maximum of the sequence number, so long cases do
    not meet in one task. Unknown statuses stay as they are stored and are never legal, nor
    is a step after one. The first step of a case must be NEW.
    """
    high, middle = id_levels(F.col("seq"))
    numbered = history.select(
        "case_id", high.alias("high"), middle.alias("middle"), "seq", F.col("seq").cast("long").alias("at")
    )
    places = prior_totals(numbered, ["case_id"], ["high", "middle", "seq"], maxes=("at",)).select(
        "case_id", "seq", F.col("prior_at").cast("long").alias("before")
    )
    earlier = history.select("case_id", F.col("seq").cast("long").alias("before"), F.col("status").alias("previous"))
    named = (
        history.select("case_id", "seq", "status")
        .join(places, ["case_id", "seq"])
        .join(earlier, ["case_id", "before"], "left")
    )
    first = F.col("before").isNull() & F.coalesce(F.col("status") == "NEW", F.lit(False))
    return named.select(
        "case_id", "seq", "previous", "status", (first | can_move(F.col("previous"), F.col("status"))).alias("legal")
    )


def _effect(action: Column, target: Column, acceptable: Column) -> Column:
    """Next status index for each current status, as an array: what the action does in any state.

    Composing these arrays composes actions, whatever the state before them.
    """
    unchanged = list(range(len(STATUSES)))
    out = F.array(*[F.lit(i) for i in unchanged])
    for i, name in enumerate(STATUSES):
        moves = [i if name in TRANSITIONS[s] else k for k, s in enumerate(STATUSES)]
        if name in DECISIONS:
            moves = [i if s in DECIDABLE else k for k, s in enumerate(STATUSES)]
        kind = "DECISION" if name in DECISIONS else "STATUS"
        applies = (action == kind) & (target == name) & acceptable
        out = F.when(applies, F.array(*[F.lit(m) for m in moves])).otherwise(out)
    return out


def _compose(items: Column) -> Column:
    """One effect array for a list of (at, effect), in order."""
    identity = F.array(*[F.lit(i) for i in range(len(STATUSES))])
    return F.aggregate(
        items,
        identity,
        lambda done, item: F.transform(done, lambda s: F.element_at(item["effect"], s + 1)),
    )


def _states(items: Column, start: Column) -> Column:
    """(at, before) for each item when the fold begins in ``start``."""
    empty = F.array().cast("array<struct<at:bigint,before:int>>")
    begin = F.struct(start.cast("int").alias("state"), empty.alias("out"))

    def step(acc, item):
        here = F.struct(item["at"].alias("at"), acc["state"].alias("before"))
        return F.struct(
            F.element_at(item["effect"], acc["state"] + 1).alias("state"),
            F.concat(acc["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(items, begin, step, lambda acc: acc["out"])


def _listed(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Effects of a group in order; a group spans at most BLOCK different ``at``."""
    item = F.struct(F.col(at).cast("long").alias("at"), F.col("effect").alias("effect"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))


def action_ranks(actions: DataFrame) -> DataFrame:
    """(case_id, seq, rank): the place of each action in its case, from 0, whatever the numbers are."""
    high, middle = id_levels(F.col("seq"))
    numbered = actions.select("case_id", high.alias("high"), middle.alias("middle"), "seq", F.lit(1).alias("n"))
    places = prior_totals(numbered, ["case_id"], ["high", "middle", "seq"], sums=("n",))
    return places.select("case_id", "seq", F.col("prior_n").cast("long").alias("rank"))


def fold_tree(acts: DataFrame, longest: int) -> list[DataFrame]:
    """Blocks of actions, blocks of blocks and so on, each with its ordered items, up to one per case.

    ``acts``: case_id, rank, effect; ``longest``: the number of actions of the longest case.
    A node of level l covers BLOCK^(l+1) ranks and lists at most BLOCK items.
    """
    tree, level = [], acts.select("case_id", F.col("rank").alias("at"), "effect")
    while True:
        node = F.floor(F.col("at") / BLOCK).cast("long").alias("node")
        tree.append(_listed(level.select("case_id", node, "at", "effect"), ["case_id", "node"], "at"))
        longest = -(-longest // BLOCK)
        if longest <= 1:
            return tree
        level = tree[-1].select("case_id", F.col("node").alias("at"), _compose(F.col("items")).alias("effect"))


def replay_actions(actions: DataFrame) -> DataFrame:
    """Outcome of each requested action, in order of ``seq``, starting from NEW.

    ``actions``: case_id, seq (a whole number, unique per case, dense or not), action (STATUS,
    DECISION or NOTE), target, acceptable (checks that need no status, such as references).
    Rejected actions change nothing. The log of a case is cut by rank into blocks. Each block
    first becomes the one mapping from status to status that its actions compose to, and so
    do blocks of blocks; down the same tree every block gets its status at entry, and the
    blocks are replayed side by side.
    """
    effect = _effect(F.col("action"), F.col("target"), F.col("acceptable"))
    ranks = cut_lineage(action_ranks(actions))
    longest = (ranks.agg(F.max("rank")).first()[0] or 0) + 1
    acts = actions.select("case_id", "seq", effect.alias("effect")).join(ranks, ["case_id", "seq"])
    tree = fold_tree(acts, longest)
    start = tree[-1].select("case_id", "items", F.lit(0).alias("before"))
    for blocks in reversed(tree[:-1]):
        entered = start.select("case_id", F.inline(_states(F.col("items"), F.col("before"))))
        start = blocks.join(entered.withColumnRenamed("at", "node"), ["case_id", "node"]).select("case_id", "items", "before")
    entered = start.select("case_id", F.inline(_states(F.col("items"), F.col("before"))))
    states = entered.join(ranks.withColumnRenamed("rank", "at"), ["case_id", "at"]).select(
        "case_id", "seq", _name(F.col("before")).alias("status_before")
    )
    before, target = F.col("status_before"), F.col("target")
    status, decision = F.col("action") == "STATUS", F.col("action") == "DECISION"
    reason = (
        F.when(F.col("action") == "NOTE", None)
        .when(status & ~target.isin(*STATUSES), "unknown_status")
        .when(status & target.isin(*DECISIONS), "decision_required")
        .when(decision & ~target.isin(*DECISIONS), "unknown_decision")
        .when(~F.col("acceptable"), "bad_reference")
        .when(status & (target == before), "same_status")
        .when(status & ~can_move(before, target), "illegal_transition")
        .when(decision & ~before.isin(*DECIDABLE), "not_decidable")
    )
    return actions.join(states, ["case_id", "seq"], "inner").select(
        "case_id",
        "seq",
        "action",
        "target",
        "status_before",
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
        F.when(reason.isNull() & (status | decision), target).otherwise(before).alias("status_after"),
    )


def case_status(history: DataFrame) -> DataFrame:
    """Current status and last update of each case from (case_id, seq, status, at)."""
    return history.groupBy("case_id").agg(
        F.max_by("status", "seq").alias("status"), F.max("at").alias("updated_at"), F.count("*").alias("steps")
    )


def validate_references(
    requests: DataFrame, evidence: DataFrame, scores: DataFrame
) -> DataFrame:
    """Reasons why a request may not cite its evidence.

    ``requests``: request_id, transaction_id, needs_evidence, evidence_ids (array).
    ``evidence``: evidence_id, transaction_id. ``scores``: transaction_id.
    """
    cited = requests.select(
        "request_id", F.col("transaction_id").alias("subject"), F.explode_outer("evidence_ids").alias("evidence_id")
    )
    owner = evidence.select("evidence_id", F.col("transaction_id").alias("owner"))
    checked = spread_join(cited, owner, ["evidence_id"], "left").groupBy("request_id").agg(
        F.count_if(F.col("evidence_id").isNotNull() & F.col("owner").isNull()).alias("unknown_evidence"),
        F.count_if(F.col("owner") != F.col("subject")).alias("foreign_evidence"),
    )
    covered = scores.select("transaction_id").distinct().withColumn("covered", F.lit(True))
    known = evidence.select("transaction_id").distinct().withColumn("known", F.lit(True))
    ids = F.coalesce(F.col("evidence_ids"), F.array().cast("array<string>"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("covered").isNull() & F.col("known").isNull(), "unknown_transaction"),
            F.when(F.col("covered").isNull() & F.col("known").isNotNull(), "transaction_not_covered"),
            F.when(F.col("needs_evidence") & (F.size(ids) == 0), "evidence_required"),
            F.when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_evidence"),
            F.when(F.col("unknown_evidence") > 0, "unknown_evidence"),
            F.when(F.col("foreign_evidence") > 0, "foreign_evidence"),
        )
    )
    flags = covered.join(known, "transaction_id", "full")
    return (
        spread_join(requests, flags, ["transaction_id"], "left", by=["request_id"])
        .join(checked, "request_id", "left")
        .select("request_id", (F.size(reasons) == 0).alias("acceptable"), F.concat_ws(",", reasons).alias("reasons"))
    )


def case_queue(
    cases: DataFrame,
    scores: DataFrame,
    decisions: DataFrame,
    status: str | None = None,
) -> DataFrame:
    """Cases with risk, evidence count and latest decision.

    ``cases``: case_id, transaction_id, status, opened_at, evidence_ids. In order of
    opened_at, newest first, then case_id.
    """
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    wanted = cases.filter(F.col("status") == status) if status else cases
    latest = decisions.groupBy("case_id").agg(
        F.max_by("decision", F.struct("decided_at", "decision_id")).alias("latest_decision"),
        F.max("decided_at").alias("decided_at"),
    )
    count = F.size(F.array_distinct(F.coalesce(F.col("evidence_ids"), F.array().cast("array<string>"))))
    return (
        wanted.join(scores.select("transaction_id", "risk_score", "risk_band"), "transaction_id", "left")
        .join(latest, "case_id", "left")
        .select(
            "case_id",
            "transaction_id",
            "status",
            "opened_at",
            "risk_score",
            "risk_band",
            count.cast("long").alias("evidence_count"),
            "latest_decision",
            "decided_at",
        )
        .orderBy(F.desc("opened_at"), "case_id")
    )


def case_detail(sections: dict[str, DataFrame]) -> DataFrame:
    """Everything about each case in order: (case_id, section, position, item_id, text).

    ``sections`` maps a name to rows (case_id, seq, item_id, text). Rows stay rows: a case
    of any length needs no list that has to fit one task.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            df.select("case_id", F.lit(name).alias("section"), F.col("seq").cast("long").alias("seq"), "item_id", "text")
            for name, df in sections.items()
        ],
    )
    # Items of one sequence number follow each other by their id.
    high, middle = id_levels(F.col("seq"))
    marks = rows.groupBy("case_id", "section", high.alias("high"), middle.alias("middle"), "seq", "item_id").agg(
        F.count("*").alias("n")
    )
    places = prior_totals(marks, ["case_id", "section"], ["high", "middle", "seq", "item_id"], sums=("n",))
    return rows.join(
        places.select("case_id", "section", "seq", "item_id", (F.col("prior_n") + 1).cast("long").alias("position")),
        ["case_id", "section", "seq", "item_id"],
        "inner",
    ).select("case_id", "section", "position", "item_id", "text")


def labels_from_decisions(decisions: DataFrame) -> DataFrame:
    """One label per terminal decision; it arrives at the whole second of the decision."""
    value = F.lit(None).cast("int")
    for name, number in LABEL_VALUES.items():
        value = F.when(F.col("decision") == name, F.lit(number)).otherwise(value)
    return decisions.filter(F.col("decision").isin(*DECISIONS)).select(
        "decision_id",
        "case_id",
        "transaction_id",
        value.alias("value"),
        F.date_trunc("second", F.col("decided_at")).alias("arrival_at"),
        F.lit("reviewer").alias("source"),
    )


def audit_decisions(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Per case: terminal decisions, labels, and whether there is at most one of each."""
    decided = decisions.filter(F.col("decision").isin(*DECISIONS)).groupBy("case_id").agg(
        F.count("*").alias("decisions")
    )
    labelled = labels.groupBy("case_id").agg(F.count("*").alias("labels"))
    count_d, count_l = F.coalesce("decisions", F.lit(0)), F.coalesce("labels", F.lit(0))
    return decided.join(labelled, "case_id", "full").select(
        "case_id",
        count_d.alias("decisions"),
        count_l.alias("labels"),
        ((count_d <= 1) & (count_l <= 1) & (count_d == count_l)).alias("consistent"),
    )


def json_list(ids: Column) -> Column:
    """Sorted distinct ids as JSON text."""
    return F.to_json(F.array_sort(F.array_distinct(ids.cast("array<string>"))))


def parse_json_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")
