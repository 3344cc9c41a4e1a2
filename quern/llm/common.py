"""Shared pieces: staged tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Characters between words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder given to setCheckpointDir; one of this machine only where all runs in one process."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs herein are removed when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run herein give Python workers so many rows at a time at most: whole texts and sets make wide rows, which the
    executor holds twice, in its JVM and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Stages:
    """Tables written to the shared folder, so that a lost executor costs a re-read and not a recomputation.

    ``table`` writes a DataFrame and returns the reader of the files; ``drop`` deletes files that no later
    step reads. What a returned DataFrame still reads stays for the owner of ``spark.checkpoint.dir``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with shuffle_files_go(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._quern_path)
            path.getFileSystem(conf).delete(path, True)


def row_key(docs: DataFrame) -> Column:
    """128 bits that any reading of ``docs`` finds again for a row: two hashes of its columns (maps left out)."""
    cols = [F.col(f.name) for f in docs.schema.fields if f.dataType.typeName() != "map"]
    return F.struct(F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit(1), *cols).alias("g"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(stages: Stages, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, component)`` per vertex, component = smallest id.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two grouped minima and two
    equi-joins over edges, so a vertex with many edges costs map-side combined rows, and nothing is gathered in one
    task. Edges are staged after each round; the loop ends when a round leaves the edge set as it was.
    Self loops and repeated edges are allowed; an empty edge set gives an empty result.
    """
    cur = stages.table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    mark = None
    while True:
        both = cur.select("a", "b").union(cur.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_low, "a")
        small = (
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small_low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        seen = Observation()
        new = stages.table(small.observe(
            seen, F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("sum"), F.bit_xor(F.xxhash64("a", "b")).alias("xor")
        ))
        stages.drop(cur)
        cur = new
        if seen.get == mark:
            break
        mark = seen.get
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        cur.select("b", "b").distinct()
    )
