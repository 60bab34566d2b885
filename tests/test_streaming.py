"""Streams give what the batch operators give on the same rows."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cases, history
from ledgerlens.plans.review import _actions
from ledgerlens.plans.tables import transactions
from ledgerlens.streaming.case_status import stream_case_status
from ledgerlens.streaming.entity_features import stream_entity_features, stream_relational_features

pytest.importorskip("google.protobuf")
FOLDER = "/root/testdata/sf0.001"


def _run(df, name, folder):
    writer = df.writeStream.format("memory").queryName(name).outputMode("append")
    q = writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return df.sparkSession.table(name)


def test_entity_features_match_batch(spark, tmp_path):
    txn = transactions(spark, FOLDER).filter("ts < 20 * 86400")
    source = tmp_path / "in"
    timed = txn.withColumn("event_time", F.timestamp_seconds("ts"))
    half = 10 * 86_400
    timed.filter(F.col("ts") < half).coalesce(1).write.parquet(str(source / "a"))
    timed.filter(F.col("ts") >= half).coalesce(1).write.parquet(str(source / "b"))
    # A last row far ahead moves the watermark past all others.
    ahead = timed.limit(1).withColumn("event_time", F.timestamp_seconds(F.lit(10**8))).withColumn(
        "ts", F.lit(10**8).cast("long")
    )
    ahead.coalesce(1).write.parquet(str(source / "c"))
    stream = (
        spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(source))
    )
    got = _run(stream_entity_features(stream), "entity_stream", tmp_path / "cp").filter("ts < 86400 * 20")
    obs = history.observations(txn, history.TxnColumns(), ("CARD", "DEVICE"))
    want = history.entity_totals(
        obs, history.STRICT, {"CARD": history.SHORT_WINDOWS, "DEVICE": history.SHORT_WINDOWS}
    )
    def shown(df):
        return {
            (r["kind"], r["key"], r["ts"]): (
                int(r["seen"]), r["last_ts"], int(r["known"]), round((r["mean"] or 0.0) + 1e-8, 6), int(r["in_1h"]), int(r["in_24h"])
            )
            for r in df.collect()
        }
    assert shown(got) == shown(want)


def _case_stream(spark, actions, source, batches):
    """A stream whose micro-batches are the filters ``batches``, closed by a row far ahead that moves the watermark."""
    for i, part in enumerate(batches):
        actions.filter(part).coalesce(1).write.parquet(str(source / f"{i}"))
    ahead = actions.limit(1).withColumns({"case_id": F.lit(-1).cast("long"), "event_time": F.timestamp_seconds(F.lit(10**8))})
    for last in ("last", "after"):  # the batch after the jump sees the new watermark
        ahead.coalesce(1).write.parquet(str(source / last))
    return (
        spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(source))
    )


def test_case_status_matches_replay(spark, tmp_path):
    actions = _actions(spark, FOLDER).withColumns(
        {"case_id": F.col("case_id").cast("long"), "seq": F.col("seq").cast("long"), "event_time": F.timestamp_seconds(F.col("seq") * 60)}
    )
    # Later actions come first: the third micro-batch holds what belongs between the others.
    batches = ["pmod(seq + case_id, 3) = 2", "pmod(seq + case_id, 3) = 0", "pmod(seq + case_id, 3) = 1"]
    got = _run(stream_case_status(_case_stream(spark, actions, tmp_path / "in", batches)), "case_stream", tmp_path / "cp")
    columns = ["case_id", "seq", "action", "target", "status_before", "accepted", "reason", "status_after"]
    want = cases.replay_actions(actions.drop("event_time")).select(*columns).collect()
    assert len({r["reason"] for r in want}) > 4
    assert sorted(map(tuple, got.filter("case_id >= 0").select(*columns).collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert got.filter("late_actions > 0").count() == 0


def test_late_actions_change_nothing_and_are_counted(spark, tmp_path):
    rows = [(1, 1, "STATUS", "INVESTIGATING"), (1, 2, "STATUS", "ESCALATED"), (1, 5, "DECISION", "CONFIRMED_FRAUD"), (1, 6, "STATUS", "CLOSED")]
    late = [(1, 3, "STATUS", "INVESTIGATING"), (1, 4, "NOTE", None)]
    made = spark.createDataFrame(rows + late, "case_id long, seq long, action string, target string")
    actions = made.withColumns({"acceptable": F.lit(True), "event_time": F.timestamp_seconds(F.col("seq") * 3600)})
    # Seq 6 moves the watermark to 5 o'clock, seq 9 of another case further; 3 and 4 come after that.
    other = spark.createDataFrame([(2, 9, "STATUS", "ESCALATED")], made.schema).withColumns(
        {"acceptable": F.lit(True), "event_time": F.timestamp_seconds(F.lit(20 * 3600))}
    )
    batches = ["seq IN (1, 2, 5, 6)", "case_id = 2", "case_id = 2 AND seq = 0", "seq IN (3, 4)"]
    got = _run(stream_case_status(_case_stream(spark, actions.union(other), tmp_path / "in", batches)), "late_stream", tmp_path / "cp")
    out = {r["seq"]: (r["accepted"], r["reason"], r["status_after"], r["late_actions"]) for r in got.filter("case_id = 1").collect()}
    assert out[6] == (True, None, "CLOSED", 0)
    assert out[3] == (False, "late", "CLOSED", 1) and out[4] == (False, "late", "CLOSED", 2)
    assert len(out) == 6


def _feature_stream(spark, txn, source, days):
    """Micro-batches cut at the given days, closed by a row far ahead that moves the watermark."""
    timed = txn.withColumn("event_time", F.timestamp_seconds("ts"))
    edges = [0, *days, 10**4]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        timed.filter((F.col("ts") >= a * 86_400) & (F.col("ts") < b * 86_400)).coalesce(1).write.parquet(str(source / f"{i}"))
    for i, last in enumerate(("last", "after")):
        ahead = timed.limit(1).withColumns({"event_time": F.timestamp_seconds(F.lit(10**9 + i)), "ts": F.lit(10**9 + i).cast("long")})
        ahead.coalesce(1).write.parquet(str(source / last))
    return (
        spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(source))
    )


def test_relational_features_match_batch(spark, tmp_path):
    txn = transactions(spark, FOLDER).filter("ts < 30 * 86400").withColumn("ts", F.floor(F.col("ts") / 3).cast("long"))
    # Gaps longer than every window, rows without amount or keys, and rows of one second.
    txn = txn.withColumn("ts", F.col("ts") + F.when(F.col("ts") > 5 * 86_400, F.lit(9 * 86_400)).otherwise(0))
    odd = txn.limit(3).withColumns(
        {"transaction_id": F.col("transaction_id") + 10**6, "amount": F.lit(None).cast("double"),
         "card_key": F.lit(None).cast("string"), "device_key": F.lit(None).cast("string"), "addr_key": F.lit(None).cast("string")}
    )
    txn = txn.unionByName(odd).unionByName(txn.filter("transaction_id % 7 = 0").withColumn("transaction_id", F.col("transaction_id") + 10**7))
    txn = txn.persist()
    got = _run(stream_relational_features(_feature_stream(spark, txn, tmp_path / "in", (2, 4, 15))), "relational_stream", tmp_path / "cp")
    want = history.relational_features(txn)

    def shown(df):
        names = ("transaction_id", *history.RELATIONAL_FEATURES)
        return {r[0]: [None if v is None else round(v + 1e-8, 5) for v in r[1:]] for r in df.select(*names).collect()}

    expected, found = shown(want), shown(got)
    assert all(found.get(k) == v for k, v in expected.items())
    assert len(found) - len(expected) <= 2
    for i in range(len(history.RELATIONAL_FEATURES)):
        assert len({v[i] for v in expected.values()}) > 1
