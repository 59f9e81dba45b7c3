"""Cutting a lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The checkpoint folder of the cluster; a local one only where all tasks run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(known)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder; Spark's cleaner may remove it when nothing refers to it any more."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """A table that is computed again and again out of itself: ``keep`` writes it and removes what the round before had written.

    Written tables, unlike checkpoints, carry no constraints of the plans that made them, which would grow with every round.
    """

    def __init__(self, spark):
        self.spark, self.folder, self.before = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", None
        self.number = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        if self.before is not None:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.before)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.before, self.number = path, self.number + 1
        return self.spark.read.schema(df.schema).parquet(path)
