"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Stages, read_table

#: Candidates in one score array, query rows in one block, and candidate rows in one group of the grid.
BLOCK, QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 4096, 16384
SAFE = 1 << 62
LONG = np.iinfo(np.int64)


def integer_vector(vector: Column) -> Column:
    """floor(64 * x) of each component, or null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 64).cast("long")))


class Postings:
    """Weighted postings of a block of rows by term; a list that holds most rows is kept as a dense array."""

    def __init__(self, rows: np.ndarray):
        self.n, self.terms = len(rows), []
        for t in range(rows.shape[1]):
            at = np.flatnonzero(rows[:, t])
            if len(at):
                dense = 2 * len(at) > self.n
                self.terms.append((t, None if dense else at, np.ascontiguousarray(rows[:, t] if dense else rows[at, t])))

    def scores(self, query: np.ndarray, out: np.ndarray, part: np.ndarray) -> np.ndarray:
        out[:] = 0
        for t, at, weights in self.terms:
            if w := query[t]:
                if at is None:
                    np.multiply(weights, w, out=part)
                    out += part
                else:
                    out[at] += weights * w
        return out


def narrow(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest type in which no inner product of rows of a and b can overflow; objects are exact integers."""
    bound = sum(int(np.abs(a[:, t]).max()) * int(np.abs(b[:, t]).max()) for t in range(a.shape[1])) if len(a) and len(b) else 0
    return np.int32 if bound < 1 << 30 else np.int64 if bound < SAFE else object


def top_rows(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query row in this pair of blocks; ties go to the smaller id."""
    candidates = candidates.sort_values("id", kind="stable")
    ids = candidates["id"].to_numpy(np.int64)
    out = []
    for width, some in queries.groupby(queries["v"].str.len()):
        q, qids, rows = np.stack(some["v"].to_numpy()), some["id"].to_numpy(np.int64), some["row"].to_numpy(np.int64)
        same = (candidates["v"].str.len() == width).to_numpy()
        if not same.any() or not width:
            continue
        c, cids = np.stack(candidates["v"].to_numpy()[same]), ids[same]
        for start in range(0, len(c), BLOCK):
            block, bids = c[start : start + BLOCK], cids[start : start + BLOCK]
            kind = narrow(q, block)
            postings, n = Postings(block.astype(kind)), len(block)
            scores, part, order = np.zeros(n, kind), np.zeros(n, kind), np.arange(n - 1, -1, -1)
            for i, query in enumerate(q.astype(kind)):
                s = postings.scores(query, scores, part)
                few = min(n, k + int((bids == qids[i]).sum()))
                if kind is np.int32:  # the score and, for ties, the place in one key
                    best = np.argpartition(s.astype(np.int64) * n + order, n - few)[n - few :]
                else:
                    best = sorted(range(n), key=lambda j: (-s[j], j))[:few]
                out += [
                    (rows[i], qids[i], int(bids[j]), max(LONG.min, min(LONG.max, int(s[j]))))
                    for j in best if bids[j] != qids[i]
                ]
    return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k candidates with the largest inner product for each row of ``queries(id, v)`` in ``candidates(id, v)``.

    v: array<bigint> from ``integer_vector``. Both sides are dealt into blocks; each pair of blocks is one group of a
    grid, in which query rows scatter weighted postings into dense score arrays and keep their k best; the partial
    lists are merged by rank. Every candidate is scored (exhaustive), ties go to the smaller id. The work is
    queries x candidates by contract; no task holds more than one block of each side.

    Rows with null id or null v take no part. A candidate with the query's id is the query's own and is left out.
    Identical query rows are one query; repeated candidates each count. Vectors of another width do not match the
    query and give nothing. Fewer than k candidates: all of them. Scores beyond 64 bits are ranked exactly and
    returned as the nearest long. Empty inputs give no rows.
    """
    stages = Stages(queries.sparkSession, "topk")
    q = stages.table(
        queries.where("id is not null and v is not null").groupBy("id", "v").agg(F.lit(1).alias("x"))
        .select("id", "v", F.xxhash64("id", "v").alias("row"))
    )
    c = candidates.where("id is not null and v is not null")
    n_q, n_c = q.count(), c.count()
    gq, gc = -(-n_q // QUERY_BLOCK) or 1, max(-(-n_c // CANDIDATE_BLOCK), min(24, -(-n_c // 512))) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("gq", F.pmod(F.col("row"), F.lit(gq)).cast("int")).withColumn("gc", every(gc))
    # dealt by a row's place, not by its id or vector: repeated rows spread over all blocks
    c = c.withColumn("gc", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(gc)).cast("int")).withColumn("gq", every(gq))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return top_rows(left, right, k)

    parts = q.groupBy("gq", "gc").cogroup(c.groupBy("gq", "gc")).applyInPandas(score, "row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), integer_vector(F.col("embedding")).alias("v"))
    return exact_topk(rows.where("id % 20 = 0"), rows, 20)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
