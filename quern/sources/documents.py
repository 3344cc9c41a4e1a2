"""Files as documents: lines with their numbers, JSON lines that name a bad row, and loading by a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions.text import git_blob_sha1
from quern.operators.ingest import checked_manifest, source_key

#: Faults that an error names.
NAMED = 5


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line of text files, numbered from 1 however a file is split.

    A split's lines are numbered in the order they are read, from the first of the split; the lines of the splits before it in
    the file are counted by one more reading, one row a split.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a file's splits
    starts = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def jsonl_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, fields..., fault) of JSON lines; blank lines are left out. ``fault`` is null for a row that is an object
    of the schema, ``json`` for one that is not, and the row's fields are then null."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("_row", parsed)
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull() | ~F.trim("value").startswith("{")
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return out.select("file", "line", *[F.when(~bad, F.col(f"_row.{c}")).alias(c) for c in names], F.when(bad, "json").alias("fault"))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """The rows of JSON lines; an error names file and line of the first bad rows, and of rows whose ``key`` is null or repeated."""
    rows = jsonl_rows(spark, path, schema)
    faults = rows.where("fault is not null").select("file", "line", "fault")
    if key:
        fine = rows.where("fault is null")
        again = fine.groupBy(key).agg(F.min(F.struct("file", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = fine.join(again, key).where(F.struct("file", "line") != F.col("first")).select("file", "line", F.lit(f"repeated {key}").alias("fault"))
        faults = faults.unionByName(twice).unionByName(fine.where(F.col(key).isNull()).select("file", "line", F.lit(f"no {key}").alias("fault")))
    found = faults.orderBy("file", "line").limit(NAMED).collect()
    if found:
        raise ValueError("; ".join(f"{r['file'].rsplit('/', 1)[-1]}:{r['line']}: {r['fault']}" for r in found))
    return rows.drop("file", "line", "fault")


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, size) of the files below ``root``, paths from there; contents are raw bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.regexp_extract("path", r"^[^:]+:/*", 0)
    bare = F.concat(F.lit("/"), F.substring("path", F.length(path) + 1, F.length("path")))
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return files.select(F.substring(bare, F.instr(bare, base) + len(base), F.length(bare)).alias("path"), "content", F.col("length").alias("size"))


def manifest_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(key, fault): manifest rows whose file is ``missing``, of another ``size`` or another ``hash``, and ``unlisted`` files.

    ``files(path, content, size)`` hold paths as collection/path. Hashes are those of git blobs over the raw bytes. Spark's
    readers pass over files without bytes, so that a manifest row of size 0 needs none if its hash is that of no bytes.
    """
    listed = checked_manifest(manifest).select(source_key(F.col("collection"), F.col("path")).alias("key"), F.col("size").alias("want"), "blob_sha1")
    hashed = files.select(F.col("path").alias("key"), "size", git_blob_sha1(F.col("content")).alias("hash"))
    both = listed.join(hashed, "key", "full_outer")
    nothing = (F.col("want") == 0) & (F.col("blob_sha1") == git_blob_sha1(F.lit(b"")))
    fault = (
        F.when(F.col("blob_sha1").isNull(), "unlisted").when(F.col("hash").isNull() & nothing, None).when(F.col("hash").isNull(), "missing").when(F.col("size") != F.col("want"), "size")
        .when(F.col("hash") != F.col("blob_sha1"), "hash")
    )
    return both.select("key", fault.alias("fault")).where("fault is not null")


def load_documents(manifest: DataFrame, files: DataFrame, unlisted: bool = False) -> DataFrame:
    """(key, content) of the manifest's files. Fails, naming faults, unless each is there with its size and hash; files that the
    manifest does not list fail too unless ``unlisted``."""
    faults = manifest_faults(manifest, files)
    faults = faults.where("fault <> 'unlisted'") if unlisted else faults
    found = faults.orderBy("key").limit(NAMED).collect()
    if found:
        raise ValueError("; ".join(f"{r['key']}: {r['fault']}" for r in found))
    keys = manifest.select(source_key(F.col("collection"), F.col("path")).alias("key"))
    return keys.join(files.select(F.col("path").alias("key"), "content"), "key", "left").select("key", F.coalesce("content", F.lit(b"")).alias("content"))
