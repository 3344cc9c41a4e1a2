"""JSON lines, last-write-wins and strict caches, cached computation and published bundles."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.operators.ingest import require


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def last_write_wins(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the highest sequence per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def strict_cache(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of exactly the wanted keys, each once; repeated, extra or missing keys fail the job."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = wanted.select(*keys).distinct().withColumn("_w", F.lit(True)).join(counts, keys, "full_outer")
    ok = require(both, F.col("_w").isNotNull() & (F.col("_n") == 1), "cache has repeated, extra or missing keys")
    return df.join(ok.select(*keys), keys)


def embedding_matrix(cache: DataFrame, wanted: DataFrame, width: int, require_all: bool = True) -> DataFrame:
    """(pos, doc_id, v) in requested order from ``cache(doc_id, v, write_seq)``, the last write of each id; vectors of
    another width or with non-finite components fail the job."""
    rows = last_write_wins(cache, ["doc_id"], "write_seq")
    fine = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    joined = wanted.select("pos", "doc_id").join(require(rows, fine, "bad vector").select("doc_id", "v"), "doc_id", "left")
    return require(joined, F.col("v").isNotNull(), "missing vector") if require_all else joined.where("v is not null")


def compute_missing(items: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``compute`` for the items that the cache lacks; the caller appends them."""
    return compute(items.join(cache.select(*keys).distinct(), keys, "left_anti"))


def client_rows(df: DataFrame, call: Callable[[list], list], column: str, schema: str, batch: int = 16) -> DataFrame:
    """Calls an injected client with batches of ``column`` and appends its results in request order.

    A repeated task repeats its calls, so clients key their effects by the request.
    """
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at in range(0, len(f), batch):
                asked = f[column].iloc[at : at + batch].tolist()
                got = call(asked)
                if len(got) != len(asked):
                    raise ValueError("client answered another number of items")
                out += got
            yield f.assign(result=out)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{fields}, result {schema}")


def provenance(expected: dict, sidecar: str) -> None:
    """Writes the sidecar of a new cache; an existing one must be equal."""
    path = Path(sidecar)
    if path.exists():
        if json.loads(path.read_text("utf-8")) != expected:
            raise ValueError(f"{sidecar}: the cache was made under another model, prompt or profile")
        return
    path.write_text(canonical_json(expected), "utf-8")


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False, indent=2) + "\n"


@contextmanager
def exclusive_lock(path: str):
    """Fails at once if the lock exists; a stale lock is never taken."""
    handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        yield
    finally:
        os.close(handle)
        os.unlink(path)


def publish(staged: dict[str, str], marker: str) -> None:
    """Renames staged files to their targets, the marker last; a failure puts the former files back."""
    order = sorted(staged, key=lambda t: t == marker)
    saved: list[tuple[str, str | None]] = []
    try:
        for target in order:
            old = f"{target}.previous" if os.path.exists(target) else None
            if old:
                os.replace(target, old)
            saved.append((target, old))
            os.replace(staged[target], target)
    except BaseException:
        for target, old in reversed(saved):
            if old:
                os.replace(old, target)
            elif os.path.exists(target):
                os.unlink(target)
        raise
    for _, old in saved:
        if old:
            os.unlink(old)


def junit_totals(xml: str) -> dict[str, int]:
    """Tests, failures, errors and skipped of the top-level suites."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(xml)
    suites = root.findall("testsuite") if root.tag == "testsuites" else [root] if root.tag == "testsuite" else []
    if not suites:
        raise ValueError("no test suites")
    return {k: sum(int(s.attrib[k]) for s in suites) for k in ("tests", "failures", "errors", "skipped")}


def harvest_documents(raw: DataFrame, fields: list[str], least: int = 200) -> DataFrame:
    """(doc_id, text): bodies of the allowed fields, stripped, of ``least`` characters, once per content."""
    from quern.functions.text import document_id, strip

    bodies = raw.select(F.explode(F.array(*fields)).alias("text")).select(strip(F.col("text")).alias("text")).where(F.length("text") >= least)
    return bodies.select(document_id(F.col("text")).alias("doc_id"), "text").groupBy("doc_id").agg(F.min("text").alias("text"))


def gold_queries(raw: DataFrame, fields: list[str], pool: DataFrame) -> DataFrame:
    """``raw(query_id, question, answer, task, fields...)`` with gold_doc_ids in field order, without repeats; queries
    with a gold document outside the pool are left out."""
    from quern.functions.text import document_id

    ids = F.array_distinct(F.filter(F.array(*[F.when(F.length(f) > 0, document_id(F.col(f))) for f in fields]), lambda x: x.isNotNull()))
    rows = raw.select("query_id", "question", "answer", "task", ids.alias("gold_doc_ids")).where(F.size("gold_doc_ids") > 0)
    gone = rows.select("query_id", F.explode("gold_doc_ids").alias("doc_id")).join(pool.select("doc_id"), "doc_id", "left_anti").select("query_id").distinct()
    return rows.join(gone, "query_id", "left_anti")
