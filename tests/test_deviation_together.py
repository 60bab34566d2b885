"""Deviation of strict rows: rows of an entity lie together, hot ones are cut into hours, with the same result."""

import random

import pytest

from ledgerlens.operators import history as H


def _rows(spark):
    r = random.Random(5)

    def some(share, value):
        return None if r.random() < share else value

    rows = [
        (i, some(0.05, r.randrange(0, 400_000, 700)), some(0.1, r.randrange(100) / 4), some(0.1, f"c{r.randrange(5)}"),
         some(0.2, f"d{r.randrange(4)}"), some(0.2, f"a{r.randrange(4)}"))
        for i in range(200)
    ]
    names = "transaction_id long, ts long, amount double, card_key string, device_key string, addr_key string"
    return spark.createDataFrame(rows + rows[:20], names)


def _told(df):
    return sorted((tuple(round(v, 7) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def txn(spark):
    return _rows(spark).localCheckpoint()


def test_hot_entities_give_the_same(txn):
    enriched = txn.filter("device_key IS NOT NULL")
    whole = _told(H.deviation_block(txn, enriched))
    assert whole == _told(H.deviation_block(txn, enriched, hot_rows=20))
    assert sum(r[4] is not None for r in whole) > 50


def test_rows_are_shuffled_once_per_entity_and_once_to_fold(txn):
    out = H.deviation_block(txn, txn.filter("device_key IS NOT NULL"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 3  # cards, the others, the others by row
    assert plan.count("Exchange hashpartitioning") <= 4


def test_rows_without_a_time_come_first(spark):
    rows = [(1, None, 4.0, "c", "d", "a"), (2, 10, 8.0, "c", "d", "a"), (3, 100_000, 1.0, "c", "d", "a")]
    df = spark.createDataFrame(rows, "transaction_id long, ts long, amount double, card_key string, device_key string, addr_key string")
    out = {r["transaction_id"]: r for r in H.deviation_block(df, df).collect()}
    assert out[1]["dev_amt_z"] is None and out[1]["pair_new_dev_card"] is None
    assert out[2]["dev_amt_z"] == pytest.approx(4_000) and out[2]["card_amt_z"] is None
    assert out[3]["dev_amt_z"] == pytest.approx(-2.5) and out[3]["card_burst_24h"] == 0.0
    assert out[3]["pair_new_dev_card"] == pytest.approx(1.0986123)


def test_row_order_needs_no_order_beyond_second_and_id(txn):
    plan = H.relational_features(txn, ties="row_order")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [entity") == 2 and "dense_rank" not in plan


def test_equal_rows_of_a_second_never_see_each_other(spark):
    rows = [(1, 10, 4.0, "c", "d"), (1, 10, 9.0, "c", "d"), (2, 10, 6.0, "c", "d"), (3, 20, 1.0, "c", "d")]
    df = spark.createDataFrame(rows, "transaction_id long, ts long, amount double, card_key string, device_key string")
    out = {r["transaction_id"]: r for r in H.relational_features(df, ties="row_order").collect()}
    assert out[1]["amt_z_card"] is None and out[1]["hours_since_last_card"] is None
    assert out[2]["amt_z_card"] == pytest.approx(-0.2) and out[2]["hours_since_last_card"] == 0.0
    assert out[2]["card_tx_1h"] == 0 and out[3]["card_tx_1h"] == 3
