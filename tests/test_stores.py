"""Sketches that merge, stores that rewrite only what they touch, imports that keep their rejects."""

import glob
import os

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ledgerlens.operators import sketches
from ledgerlens.sources import stores

SCHEMA = StructType([StructField("k", LongType()), StructField("v", DoubleType()), StructField("at", LongType())])


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.write_store(spark.range(1000).select(F.col("id").alias("k"), F.lit(1.0).alias("v"), F.lit(0).cast("long").alias("at")), path, ["k"], 32)
    before = _files(path)
    incoming = spark.createDataFrame([(5, 2.0, 1), (5, 3.0, 2), (5000, 4.0, 1), (None, 5.0, 1)], SCHEMA)
    touched = stores.upsert_into_store(incoming, path, ["k"], "at", 32)
    assert 1 <= len(touched) <= 3
    after = _files(path)
    kept = {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched}
    assert len(kept) > 25 and all(after[f] == before[f] for f in kept)
    rows = {r["k"]: r["v"] for r in stores.read_store(spark, path, SCHEMA).collect()}
    assert len(rows) == 1002 and rows[5] == 3.0 and rows[5000] == 4.0 and rows[None] == 5.0
    assert stores.upsert_into_store(incoming.limit(0), path, ["k"], "at", 32) == []
    assert _files(path) == after


def test_append_keeps_known_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.write_store(spark.createDataFrame([(1, 1.0, 0)], SCHEMA), path, ["k"], 8)
    stores.append_into_store(spark.createDataFrame([(1, 9.0, 1), (2, 8.0, 1), (2, 7.0, 1)], SCHEMA), path, "k", 8)
    assert sorted(map(tuple, stores.read_store(spark, path, SCHEMA).collect())) == [(1, 1.0, 0), (2, 7.0, 1)]


def test_rejects_keep_their_text(spark, tmp_path):
    schema = StructType([StructField("a", LongType()), StructField("b", DoubleType()), StructField("c", StringType())])
    (tmp_path / "in.csv").write_text('a,b,c\n1,2.5,x\nbad,1,y\n3,,"q,r"\n4,1\n5,1,z,more\n')
    good, bad = stores.read_csv_with_rejects(spark, str(tmp_path / "in.csv"), schema)
    assert sorted(map(tuple, good.collect()), key=str) == [(1, 2.5, "x"), (3, None, "q,r")]
    assert {r["_rejected"] for r in bad.select("_rejected").collect()} == {"bad,1,y", "4,1", "5,1,z,more"}
    assert good.count() == 2 and bad.count() == 3


def test_ages_of_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "s" / "old"))
    spark.range(3, 5).withColumn("late", F.lit("x")).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "s" / "new"))
    wanted = StructType([StructField("id", LongType()), StructField("never", DoubleType()), StructField("late", StringType())])
    out = stores.read_ages(spark, str(tmp_path / "s"), wanted)
    assert out.columns == ["id", "never", "late", "more"]
    assert sorted(map(tuple, out.collect()), key=str)[0] == (0, None, None, None) and out.filter("late = 'x'").count() == 2


def test_sketches_merge(spark):
    df = spark.range(100_000).select(F.col("id"), (F.col("id") % 5_000).alias("few"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("gaps"))
    parts = sketches.quantile_sketches(df, "gaps", F.col("id") % 7)
    assert parts.count() == 7
    for r in sketches.merged_quantiles(parts, (0.01, 0.5, 0.99)).collect():
        assert r["rows"] == 75_000 and abs(r["quantile"] / 100_000 - r["fraction"]) < 0.01
    assert sketches.merged_quantiles(parts.limit(0), (0.5,)).count() == 0
    found = {r["column_name"]: r for r in sketches.merged_profile(sketches.partial_profile(df, ("few", "gaps"), F.col("id") % 7)).collect()}
    assert found["few"]["missing"] == 0 and found["gaps"]["missing"] == 25_000 and found["gaps"]["missing_pct"] == 25.0
    assert abs(found["few"]["distinct_values"] - 5_000) <= 100 and abs(found["gaps"]["distinct_values"] - 75_000) <= 1_500
    assert (found["few"]["min_number"], found["few"]["max_number"], found["few"]["min_text"]) == (0.0, 4999.0, None)
