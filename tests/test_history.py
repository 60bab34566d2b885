"""History features on hand-made rows, against a row-by-row reading of the rules, and under skew."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import history as H
from ledgerlens.operators.running import prior_totals, time_slot

SCHEMA = "transaction_id long, ts long, amount double, card_key string, device_key string, addr_key string"


def features(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return {r["transaction_id"]: r for r in H.relational_features(df, **kw).collect()}


def brute(rows, min_history=2):
    """Strict features straight from their definition."""
    out = []
    for t, amount, card, device, addr in rows:
        r = {}
        for name, idx, key in (("card", 2, card), ("device", 3, device)):
            past = [x for x in rows if key is not None and x[idx] == key and x[0] < t]
            amounts = [x[1] for x in past if x[1] is not None]
            z = None
            if key is not None and amount is not None and len(amounts) >= min_history:
                mean = sum(amounts) / len(amounts)
                sd = math.sqrt(sum((a - mean) ** 2 for a in amounts) / len(amounts))
                z = (amount - mean) / max(sd, 1e-3)
            r[f"amt_z_{name}"] = z
            r[f"hours_since_last_{name}"] = (t - max(x[0] for x in past)) / 3600 if past else None
            short = {"card": "card", "device": "dev"}[name]
            for label, w in (("1h", 3600), ("24h", 86400)):
                r[f"{short}_tx_{label}"] = None if key is None else float(sum(x[0] >= t - w for x in past))

        def partners(idx, key, other, w):
            joint = [x for x in rows if x[idx] == key and x[other] is not None and x[0] < t]
            return float(len({x[other] for x in joint if x[0] >= t - w})) if joint else None

        both = card is not None and device is not None
        met = sum(x[2] == card and x[3] == device and x[0] < t for x in rows)
        r["is_new_device_card_pair"] = float(met == 0) if both else None
        r["log_pair_count_device_card"] = math.log1p(met) if both else None
        r["device_distinct_cards_24h"] = partners(3, device, 2, 86400) if both else None
        r["card_distinct_devices_24h"] = partners(2, card, 3, 86400) if both else None
        has_addr = card is not None and addr is not None
        r["addr_distinct_cards_7d"] = partners(4, addr, 2, 604800) if has_addr else None
        out.append(r)
    return out


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-6)


def check(spark, rows):
    got = features(spark, rows)
    for i, want in enumerate(brute(rows)):
        for name, value in want.items():
            assert close(got[i][name], value), (i, rows[i], name, got[i][name], value)


def random_rows(n, seed, span, cards=4, devices=3):
    rnd = random.Random(seed)
    def maybe(x, p):
        return x if rnd.random() > p else None
    return [
        (
            rnd.randrange(span), maybe(round(rnd.uniform(1, 99), 2), 0.1), maybe(f"c{rnd.randrange(cards)}", 0.1),
            maybe(f"d{rnd.randrange(devices)}", 0.3), maybe(f"a{rnd.randrange(3)}", 0.3),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed,span", [(1, 3 * 86400), (2, 40)])
def test_matches_definition(spark, seed, span):
    """Spread out rows, and rows that mostly share their second."""
    check(spark, random_rows(120, seed, span))


def test_hot_entity_matches_definition(spark):
    """One card, device and address holds most rows."""
    rnd = random.Random(3)
    rows = [
        (rnd.randrange(4 * 3600), 5.0, "hot", "hot", "hot") if i % 3 else r
        for i, r in enumerate(random_rows(150, 3, 4 * 3600))
    ]
    check(spark, rows)


def test_ties_are_not_prior(spark):
    got = features(spark, [(1000, 50.0, "c1", "d1", "a1"), (1000, 60.0, "c1", "d2", "a1")])
    for i in (0, 1):
        assert got[i]["card_tx_24h"] == 0.0
        assert got[i]["hours_since_last_card"] is None
        assert got[i]["is_new_addr_card_pair"] == 1.0
    rows = features(spark, [(1000, 50.0, "c1", "d1", "a1"), (1000, 60.0, "c1", "d2", "a1")], ties="row_order")
    assert rows[1]["hours_since_last_card"] == 0.0 and rows[1]["card_tx_24h"] == 0.0


def test_half_open_window(spark):
    t = 200_000
    got = features(spark, [(x, 1.0, "c", None, None) for x in (t - 86_400, t - 1, t, t - 86_401)])
    assert got[2]["card_tx_24h"] == 2.0


def test_z_needs_two_earlier_amounts(spark):
    got = features(spark, [(1, 10.0, "c", None, None), (2, 30.0, "c", None, None), (3, 100.0, "c", None, None)])
    assert got[0]["amt_z_card"] is None and got[1]["amt_z_card"] is None
    assert got[2]["amt_z_card"] == pytest.approx(8.0)


def test_large_equal_amounts_have_no_spread(spark):
    rows = [(i, 1e9 + 0.1, "c", None, None) for i in range(50)] + [(100, 1e9 + 1.1, "c", None, None)]
    assert features(spark, rows)[50]["amt_z_card"] == pytest.approx(1000.0, rel=1e-3)


def test_missing_entities(spark):
    got = features(spark, [(1, 5.0, None, None, None)])[0]
    assert all(got[c] is None for c in H.RELATIONAL_FEATURES)


def test_later_rows_change_nothing(spark):
    rows = random_rows(60, 7, 86_400)
    later = [(r[0] + 2 * 86_400, *r[1:]) for r in random_rows(40, 8, 86_400)]
    short, full = features(spark, rows), features(spark, rows + later)
    for i in short:
        assert all(close(short[i][c], full[i][c]) for c in H.RELATIONAL_FEATURES)


def test_prior_totals_of_deep_levels(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), t, float(rnd.randrange(9))) for t in rnd.sample(range(20_000), 300)]
    df = spark.createDataFrame(rows, "k string, t long, v double").select(
        "k", time_slot(F.col("t"), 3600).alias("h"), time_slot(F.col("t"), 60).alias("m"), "t", "v",
        F.col("v").alias("top"),
    )
    got = {(r["k"], r["t"]): (r["prior_v"], r["prior_top"]) for r in
           prior_totals(df, ["k"], ["h", "m", "t"], sums=("v",), maxes=("top",)).collect()}
    for k, t, _ in rows:
        past = [x[2] for x in rows if x[0] == k and x[1] < t]
        assert got[(k, t)] == (sum(past), max(past) if past else None)


@pytest.mark.parametrize("hot_rows", [10_000, 25])
def test_short_slots_match_definition(spark, hot_rows):
    """Forty days in slots of seven, without and with hot entities, whose rows take the other way."""
    rows = random_rows(150, 11, 40 * 86_400) + [(39 * 86_400 + i % 7, 3.0, "c0", "d1", "a2") for i in range(12)]
    got = features(spark, rows, slot_s=7 * 86_400, hot_rows=hot_rows)
    for i, want in enumerate(brute(rows)):
        for name, value in want.items():
            assert close(got[i][name], value), (i, rows[i], name, got[i][name], value)


@pytest.mark.parametrize("ties", ["strict", "row_order"])
def test_hot_and_settled_entities_agree(spark, ties):
    rows = [(t // 3600 * 3600, *r) for t, *r in random_rows(120, 12, 16 * 86_400)]
    want = features(spark, rows, ties=ties, hot_rows=1)
    for kw in ({}, {"slot_s": 7 * 86_400}, {"hot_rows": 35}):
        got = features(spark, rows, ties=ties, **kw)
        for i in want:
            assert all(close(got[i][c], want[i][c]) for c in H.RELATIONAL_FEATURES), (kw, i, got[i], want[i])


@pytest.mark.parametrize("ties", ["strict", "row_order"])
def test_rows_without_time_agree(spark, ties):
    rows = [(None if i % 9 == 0 else t // 3600 * 3600, *r) for i, (t, *r) in enumerate(random_rows(90, 13, 9 * 86_400))]
    want = features(spark, rows, ties=ties, hot_rows=1)
    for kw in ({}, {"slot_s": 7 * 86_400}):
        got = features(spark, rows, ties=ties, **kw)
        for i in want:
            assert all(close(got[i][c], want[i][c]) for c in H.RELATIONAL_FEATURES), (kw, i, got[i], want[i])


def test_rows_are_shuffled_once_per_entity_and_once_to_fold(spark):
    """No join, so no table is broadcast through the driver, and two shuffles."""
    df = spark.createDataFrame([(0, 1, 1.0, "c", "d", "a")], SCHEMA)
    for ties in ("strict", "row_order"):
        plan = H.relational_features(df, ties=ties)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 2, plan


def test_plan_keeps_entities_apart(spark):
    """No window gathers an entity: every window is limited to a slot or runs over slots."""
    df = spark.createDataFrame([(0, 1, 1.0, "c", "d", "a")], SCHEMA)
    plan = H.relational_features(df)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_slot" in line, line


def _cumulated(spark, rows, hot_rows):
    """All columns of ``history_block`` by row, with entities of more than ``hot_rows`` rows cut into hours."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    blocks = {H.CARD: ("card", H.LONG_WINDOWS), H.ADDRESS: ("addr", H.SHORT_WINDOWS), H.DEVICE: ("dev", H.SHORT_WINDOWS)}
    pairs = {H.DEVICE_CARD: ("dev", "card"), H.DEVICE_ADDRESS: ("dev", "addr"), H.ADDRESS_CARD: ("addr", "card")}
    history = H.cumulative_history(df, blocks, hot_rows=hot_rows)
    both = history.join(H.cumulative_partners(df, pairs, hot_rows=hot_rows), "transaction_id", "full")
    return {r["transaction_id"]: r.asDict() for r in both.collect()}


def test_cumulative_rows_together_and_by_hour_agree(spark):
    """The rows of an entity in one task, all of them cut into hours, and some of each."""
    rows = [(None if i % 11 == 0 else t // 900 * 900, *r) for i, (t, *r) in enumerate(random_rows(110, 17, 12 * 86_400))]
    rows += rows[:5] + [(5, 1.0, None, None, None)]
    want = _cumulated(spark, rows, 1)
    assert len(want) == len(rows)
    for hot_rows in (10_000, 40):
        got = _cumulated(spark, rows, hot_rows)
        assert got.keys() == want.keys()
        for i, r in want.items():
            assert all(close(got[i][c], v) for c, v in r.items()), (hot_rows, i, got[i], r)


def test_partner_met_without_a_time_is_never_new(spark):
    rows = [(None, 1.0, "c", "d1", None), (10, 1.0, "c", "d1", None), (20, 1.0, "c", "d2", None), (30, 1.0, "c", "d3", None)]
    for hot_rows in (1, 10):
        got = _cumulated(spark, rows, hot_rows)
        assert [got[i]["card_distinct_dev_prior"] for i in range(4)] == [None, 0.0, 0.0, 1.0]


def test_cumulative_rows_are_shuffled_once_per_entity_and_once_to_fold(spark):
    df = spark.createDataFrame([(0, 1, 1.0, "c", "d", "a")], SCHEMA)
    for made in (
        H.cumulative_history(df, {H.CARD: ("card", H.LONG_WINDOWS)}),
        H.cumulative_partners(df, {H.DEVICE_CARD: ("dev", "card"), H.ADDRESS_CARD: ("addr", "card")}),
    ):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 2, plan
