"""Reciprocal rank fusion, prefix reranking and the hybrid pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lexical import EXACT, top_k

RRF_K = 10


def reciprocal_rank_fusion(runs: DataFrame, k: int = RRF_K, depth: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) from ``runs(system, query_id, rank, doc_id)``.

    A document counts once per system, at its best rank; ``depth`` cuts each run first. score is the sum of
    weight / (k + rank), in exact decimals.
    """
    cut = runs if depth is None else runs.where(F.col("rank") <= depth)
    if weights is not None:
        w = F.create_map(*[F.lit(x) for item in weights.items() for x in item])[F.col("system")]
    else:
        w = F.lit(1.0)
    best = cut.groupBy("query_id", "doc_id", "system").agg(F.min("rank").alias("rank"))
    scored = best.groupBy("query_id", "doc_id").agg(F.sum((w / (k + F.col("rank"))).cast(EXACT)).alias("score"))
    return top_k(scored, 2**31 - 1)


def rerank_prefix(run: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """Reorders the first ``depth`` of each query of ``run(query_id, rank, doc_id)`` by ``scores(query_id, doc_id,
    rerank_score)``; equal scores keep their prior order, the tail is untouched. A missing score is an error."""
    joined = run.join(scores, ["query_id", "doc_id"], "left")
    s = F.when(F.col("rank") > depth, F.lit(0.0)).otherwise(
        F.coalesce(-F.col("rerank_score"), F.raise_error(F.lit("a reranked document has no score")).cast("double"))
    )
    w = Window.partitionBy("query_id").orderBy(F.col("rank") > depth, s, F.col("rank"))
    return joined.select("query_id", "doc_id", F.col("rank").alias("prior_rank"), F.row_number().over(w).alias("rank"))


def missing_score_queries(run: DataFrame, scores: DataFrame, depth: int) -> DataFrame:
    """query_id of queries whose first ``depth`` documents lack any score."""
    return (
        run.where(F.col("rank") <= depth).join(scores, ["query_id", "doc_id"], "left")
        .groupBy("query_id").agg(F.bool_or(F.col("rerank_score").isNull()).alias("missing")).where("missing").select("query_id")
    )


def union_runs(**systems: DataFrame) -> DataFrame:
    out = None
    for name, run in systems.items():
        part = run.select(F.lit(name).alias("system"), "query_id", "rank", "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


def hybrid(sparse: DataFrame, dense: DataFrame, k: int = RRF_K, depth: int = 100, top: int = 10) -> DataFrame:
    """Both arms fused in one plan; the ``top`` best."""
    return reciprocal_rank_fusion(union_runs(sparse=sparse, dense=dense), k, depth).where(F.col("rank") <= top)


def rank_bucket(rank: Column) -> Column:
    return (
        F.when(rank == 1, "1").when(rank <= 3, "2-3").when(rank <= 10, "4-10").when(rank <= 100, "11-100").otherwise(">100")
    )
