"""Ring labels, entity columns of any roles and the comparison of models."""

from pyspark.sql import functions as F

from ledgerlens.operators import rings as R
from ledgerlens.operators.history import SHORT_WINDOWS, cumulative_history, cumulative_partners


def test_labels_come_from_ring_membership(spark):
    txn = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "transaction_id long, account string")
    rings = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r2", "c"), ("r3", None)], "ring string, node string")
    got = {r["transaction_id"]: r["is_ring"] for r in R.label_rings(txn, rings, "account").collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1}


def test_any_list_of_roles(spark):
    roles = R.EntityRoles({"M": "merchant", "A": "account", "D": "device"}, {"MA": ("M", "A"), "DM": ("D", "M")}, row_id="id", ts="t", amount="x")
    rows = [(1, 100, 5.0, "m1", "a1", "d1"), (2, 200, 7.0, "m1", "a2", None), (3, 4000, 9.0, "m1", "a1", "d1"), (4, 4000, 1.0, None, "a1", "d2")]
    df = spark.createDataFrame(rows, "id long, t long, x double, merchant string, account string, device string")
    out = {r["id"]: r for r in R.entity_columns(df, roles, {"M": "m", "A": "a", "D": "d"}).collect()}
    assert [out[i]["m_tx_prior"] for i in (1, 2, 3, 4)] == [0, 1, 2, None]
    assert [out[i]["m_amt_prior_mean"] for i in (1, 2, 3)] == [None, 5.0, 6.0]
    assert [out[i]["m_distinct_a_prior"] for i in (1, 2, 3, 4)] == [0, 1, 2, None]
    assert [out[i]["a_tx_prior"] for i in (3, 4)] == [1, 1]
    assert [out[i]["d_distinct_m_prior"] for i in (1, 2, 3)] == [0, None, 1]
    assert out[3]["m_tx_prior_1h"] == 0 and out[3]["m_tx_prior_24h"] == 2


def test_hot_entities_of_any_roles(spark):
    """Entities cut into hours give what they give when their rows lie together."""
    roles = R.EntityRoles({"M": "merchant", "A": "account"}, {"MA": ("M", "A")}, row_id="id", ts="t", amount="x")
    rows = [(i, i * 1_700 % 90_000, float(i % 7), f"m{i % 3 % 2}" if i % 5 else None, f"a{i * i % 11}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t long, x double, merchant string, account string")
    whole = R.entity_columns(df, roles, {"M": "m", "A": "a"})
    blocks, pairs = {"M": ("m", SHORT_WINDOWS), "A": ("a", SHORT_WINDOWS)}, {"MA": ("m", "a")}
    cut = cumulative_history(df, blocks, roles, hot_rows=8).join(cumulative_partners(df, pairs, roles, hot_rows=8), "id")

    def plain(out):
        return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.select(*whole.columns).collect()])

    assert plain(cut) == plain(whole) and len(plain(whole)) == 60


def test_shared_devices_tell_rings(spark):
    """Rings share devices; the amount says nothing. The model with entity columns ranks far better."""
    rows = []
    for i in range(3_000):
        ring = i % 15 == 0
        device = f"r{i // 15 % 3}" if ring else f"d{i}"
        rows.append((i, i * 600, float(i * 37 % 101), f"acc{i}" if not ring else f"ring{i % 45}", device, int(ring)))
    df = spark.createDataFrame(rows, "transaction_id long, ts long, amount double, account string, device string, is_ring int")
    roles = R.EntityRoles({"D": "device"})
    split = df.withColumn("split", F.when(F.col("ts") < 1_200_000, "train").when(F.col("ts") < 1_500_000, "valid").otherwise("test"))
    matrix = split.join(R.entity_columns(df, roles, {"D": "dev"}), "transaction_id")
    inputs = ["amount", *[c for c in matrix.columns if c.startswith("dev_")]]
    small = {"max_iter": 10, "max_depth": 3}
    out = {r["model_version"]: r for r in R.compare_models(matrix, {"base": ["amount"], "graph": inputs}, trees=small).collect()}
    assert set(out) == {"base", "graph"}
    for r in out.values():
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == 500 and r["fn"] + r["tp"] == 33  # of i in 2,500 .. 2,999
    assert out["graph"]["pr_auc"] > 0.95 > 0.5 > out["base"]["pr_auc"]
    assert out["graph"]["f1"] > 0.9 and 0 < out["graph"]["threshold"] < 1
