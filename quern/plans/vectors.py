"""Registered queries: search with the vector index, approximate and exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ann
from quern.sources.staging import Staging

from .registry import query
from .retrieval import DENSE, vectors

#: Share of the nearest vectors that the chosen probes have to reach on the calibration queries.
TARGET = 0.95


def asked(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("doc_id", "v")
    return rows, rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "v")


def rounded(run):
    return run.select("query_id", "doc_id", F.round(F.round("score", 8).cast("double"), 6).alias("score"), "rank")


@query()
def ann_topk(spark, sf_dir):
    """The ten nearest vectors in the probed cells, and the share of all rows that each query read."""
    rows, queries = asked(spark, sf_dir)
    index = ann.build(rows, Staging(spark, "ann").path())
    count = ann.probes_for(index, queries, 10, TARGET)
    run = ann.search(index, queries, 10, count)
    ann.verify_plan(run, index)
    read = ann.rows_read(index, ann.probes(index, queries, count))
    return rounded(run).join(read.select("query_id", F.col("rows").alias("rows_read"), "share"), "query_id")


@query("WITH " + DENSE + " SELECT query_id, doc_id, round(CAST(round(score, 8) AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10")
def ann_exact_topk(spark, sf_dir):
    """The index's exact search: a second round reads every cell that its bound does not rule out."""
    rows, queries = asked(spark, sf_dir)
    index = ann.build(rows, Staging(spark, "ann").path())
    return rounded(ann.search_exact(index, queries, 10, max(1, len(index.rows) // 8)))
