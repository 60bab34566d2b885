"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import shared_dir


# Rows of a batch handed to Python at once; whole texts can be long.
BATCH_ROWS = 1_000


class Scratch:
    """Tables of one operator call, written as Parquet so that a lost executor costs no recomputation.

    ``keep`` writes a table and reads it back; ``drop`` removes one that no later step
    reads. Tables that the returned DataFrame reads stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._places: dict[int, str] = {}
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
            spark.conf.set(rows, str(BATCH_ROWS))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        place = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(place)
        # Lets Spark's cleaner see that the shuffle files of finished steps are not needed.
        gc.collect()
        self.spark._jvm.System.gc()
        kept = self.spark.read.schema(df.schema).parquet(place)
        self._places[id(kept)] = place
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            place = self._places.pop(id(df), None)
            if place is not None:
                jvm = self.spark._jvm
                path = jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
