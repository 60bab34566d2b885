"""Rules over neighbourhoods make the members where the entity lies and no more often than needed."""

from pyspark.sql import functions as F

from ledgerlens.operators import evidence as E
from ledgerlens.operators import graph as G


def _data(spark):
    rows = [(i, i * 1_000, f"c{i % 3}", f"d{i % 4}" if i % 5 else None, f"a{i % 2}", i / 20) for i in range(20)]
    rows += [(7, 7_500, "c1", "d9", None, 0.9), (None, 50, "c1", None, "a1", 0.2)]
    txn = spark.createDataFrame(rows, "transaction_id long, ts long, card_key string, device_key string, addr_key string, risk_score double")
    return txn, G.build_links(txn)


def test_community_ids_come_with_the_summary(spark):
    txn, links = _data(spark)
    params = G.ExpansionParams(hub_degree_max=12, neighbor_cap=3)
    plain = G.expand(links, txn, params)
    want = E.ev_community(G.community_summary(links, txn, txn, params, plain), plain)
    carried = G.expand(links, txn, params, G.held_scores(txn))
    summary = G.community_summary(links, txn, txn, params, carried, ids=True)
    got = E.ev_community(summary, carried)

    def told(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    assert told(got) == told(want) and len(told(want)) == 20
    # Without the ids nothing gathers them.
    assert "collect_set(member_id" not in got.select(*E.RECORD[:6])._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_shuffled_to_their_entity_before_bounds_are_added(spark):
    txn, links = _data(spark)
    places, ranges = G._ranges(links, txn, G.ExpansionParams())
    for df in (places, ranges):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # From the last step down: the bounds' rows are made above the shuffle that brings links together.
        assert plan.index("Window") < plan.index("role, -1") < plan.index("REPARTITION_BY_COL")
        assert plan[: plan.index("role, -1")].count("Exchange") == 0


def test_properties_are_parsed_once_per_row(spark, tmp_path):
    from ledgerlens.functions.keys import clean_key
    from ledgerlens.plans.tables import transactions

    rows = [(1, "2024-01-01 00:00:05", 14, "click", 3.0, '{"k": 7}'), (2, "2024-01-02 00:00:00", None, "view", None, '{"k": 8}'), (3, None, 3, "error", 1.0, None)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    txn = transactions(spark, str(tmp_path))
    assert txn._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
    got = [tuple(r) for r in txn.orderBy("transaction_id").select("ts", "card_key", "device_key", "addr_key").collect()]
    assert got == [(5, "14", "7", "7"), (86_400, None, None, None), (None, "3", None, "1")]
    texts = ["1.0", " 12.000 ", "1.0E7", "1.25E1", "a.b", ".", "-3.0", "nan", "None", "", " ", "7\n", "12.0x", None]
    keys = spark.createDataFrame([(t,) for t in texts], "t string").select(clean_key(F.col("t")))
    assert [r[0] for r in keys.collect()] == ["1", "12", "10000000", "12.5", "a.b", ".", "-3", None, None, None, None, "7\n", "12.0x", None]
