"""Tables staged in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the folder of setCheckpointDir; a folder of this machine only where all runs in one process."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


class Staging:
    """Written and read again, a table has no lineage: a lost executor costs a re-read. Files stay for the folder's owner
    unless ``drop`` removes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._staged_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
