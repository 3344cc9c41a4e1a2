"""Manifest, scope, planning and delta of a document collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import framed_sha256, git_blob_sha1

from .chunking import chunk_documents

SOURCE_SCHEMA, CHUNK_SCHEMA, META_SCHEMA = "quern-source-v1", "quern-chunk-v1", "quern-metadata-v1"
DEFAULT_EXCLUDED = ("temporal_releases",)


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Rows as they are; the job fails on the first row for which ``ok`` is not true."""
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def checked_manifest(manifest: DataFrame) -> DataFrame:
    """``manifest(path, blob_sha1, size, collection, theme, category, source_url)`` with required fields, 40 hex digits
    of hash, sizes from 0 and no repeated path; an error otherwise."""
    fields = ["path", "blob_sha1", "collection", "theme", "category", "source_url"]
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.col(f).isNotNull() & (F.col(f) != "")
    ok = ok & F.col("blob_sha1").rlike("^[0-9a-f]{40}$") & (F.col("size") >= 0)
    rows = require(manifest, ok, "manifest row is incomplete")
    n = rows.groupBy("collection", "path").agg(F.count("*").alias("_n"))
    return require(rows.join(n, ["collection", "path"]), F.col("_n") == 1, "manifest repeats a path").drop("_n")


def scope_selects(include_collections=None, exclude_collections=DEFAULT_EXCLUDED, include_themes=None) -> Column:
    """Exclusion wins, then collections, then themes."""
    ok = ~F.col("collection").isin(*exclude_collections) if exclude_collections else F.lit(True)
    if include_collections is not None:
        ok = ok & F.col("collection").isin(*include_collections)
    if include_themes is not None:
        ok = ok & F.col("theme").isin(*include_themes)
    return ok


def source_key(collection: Column, path: Column) -> Column:
    return F.concat_ws("/", collection, path)


def chunk_id(key: Column, ordinal: Column, text: Column) -> Column:
    return framed_sha256(F.lit(CHUNK_SCHEMA), key, ordinal.cast("string"), text)


def metadata_fingerprint(metadata: Column) -> Column:
    """Digest of a map by sorted keys."""
    entries = F.array_sort(F.map_entries(metadata))
    body = F.array_join(F.transform(entries, lambda e: F.concat(F.length(e["key"]), F.lit(":"), e["key"], F.length(e["value"]), F.lit(":"), e["value"])), "")
    return framed_sha256(F.lit(META_SCHEMA), body)


def plan_documents(manifest: DataFrame, files: DataFrame, scope: Column, **chunking) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of the selected manifest rows; ``files(key, content)`` are verified by size and blob hash.

    The scope filters the manifest before files are joined.
    """
    wanted = checked_manifest(manifest).where(scope).withColumn("key", source_key(F.col("collection"), F.col("path")))
    joined = wanted.join(files, "key", "left")
    verified = require(
        joined, F.col("content").isNotNull() & (F.octet_length("content") == F.col("size")) & (git_blob_sha1(F.col("content")) == F.col("blob_sha1")),
        "a file is missing or differs from the manifest",
    )
    meta = F.create_map(*[x for c in ("collection", "theme", "category", "source_url") for x in (F.lit(c), F.col(c))])
    documents = verified.select("key", F.sha2("content", 256).alias("document_sha256"), metadata_fingerprint(meta).alias("metadata_fingerprint"))
    chunks = chunk_documents(verified.select("key", F.decode("content", "UTF-8").alias("text")), **chunking)
    return documents, chunks.withColumn("chunk_id", chunk_id(F.col("key"), F.col("ordinal"), F.col("contextual_text")))


DELTAS = ("added", "updated", "metadata_only", "unchanged", "deleted", "out_of_scope")


def document_delta(planned: DataFrame, previous: DataFrame, manifest_keys: DataFrame) -> DataFrame:
    """(key, delta) for planned and previous ``(key, document_sha256, metadata_fingerprint)``.

    A previous document that is not planned is out_of_scope if the manifest lists it, else deleted.
    """
    new = planned.select("key", F.col("document_sha256").alias("ns"), F.col("metadata_fingerprint").alias("nm"), F.lit(True).alias("p"))
    old = previous.select("key", F.col("document_sha256").alias("os"), F.col("metadata_fingerprint").alias("om"), F.lit(True).alias("o"))
    listed = manifest_keys.select("key").distinct().withColumn("m", F.lit(True))
    both = new.join(old, "key", "full_outer").join(listed, "key", "left")
    kind = (
        F.when(F.col("p").isNull(), F.when(F.col("m"), "out_of_scope").otherwise("deleted"))
        .when(F.col("o").isNull(), "added").when(~F.col("ns").eqNullSafe(F.col("os")), "updated")
        .when(~F.col("nm").eqNullSafe(F.col("om")), "metadata_only").otherwise("unchanged")
    )
    return both.select("key", kind.alias("delta"))


def every_scoped_planned(manifest: DataFrame, planned: DataFrame, scope: Column) -> DataFrame:
    """The planned rows; an error naming up to three keys if the scope selects a manifest document that has no plan,
    because a delta of a partial plan would delete what the manifest still lists. Runs a job at once: a check within
    the plan would go with the rows that an outer join drops."""
    wanted = manifest.where(scope).select(source_key(F.col("collection"), F.col("path")).alias("key"))
    missing = [r["key"] for r in wanted.join(planned, "key", "left_anti").limit(3).collect()]
    if missing:
        raise ValueError(f"documents in scope were not planned: {', '.join(sorted(missing))}")
    return planned


def delta_counts(delta: DataFrame) -> DataFrame:
    return delta.agg(*[F.count_if(F.col("delta") == d).alias(d) for d in DELTAS])


def reusable_chunks(planned: DataFrame, previous: DataFrame, same_profile: bool) -> DataFrame:
    """Chunk ids whose vectors can be kept: those already indexed under the same embedding profile."""
    ids = planned.select("chunk_id").join(previous.select("chunk_id"), "chunk_id", "left_semi")
    return ids if same_profile else ids.limit(0)
