"""Exact cosine search over embeddings, and prefix (matryoshka) vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.text import bind

from .lexical import EXACT

#: Queries of one block, candidates of one block, components of a block of candidates, and scores held at once.
BROADCAST_QUERIES, CANDIDATE_BLOCK, BLOCK_CELLS, SCORES = 4096, 32_768, 2_097_152, 2_097_152
#: Partitions for each pair of blocks, so that few tasks get several pairs.
SPREAD = 4
#: Decimal places to which scores are ranked, and a difference above which they and the error of doubles leave an order.
PLACES, SLACK = 8, 2e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prefix_normalised(v: Column, width: int | None = None) -> Column:
    """The first ``width`` components scaled to norm 1; an error for a zero norm or a shorter vector."""
    cut = F.slice(v, 1, width) if width else v
    checked = cut if width is None else F.when(F.size(v) >= width, cut).otherwise(F.raise_error(F.lit("vector is shorter than the prefix")))

    def scaled(c: Column) -> Column:
        norm = F.sqrt(dot(c, c))
        return F.transform(c, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("zero norm")).cast("double")))

    return bind(checked, scaled)


def cosine(dv: Column, qv: Column) -> Column:
    norm = lambda c: F.sqrt(dot(c, c))
    return (dot(dv, qv) / (norm(dv) * norm(qv))).cast(EXACT)


def nearest(scored: DataFrame, k: int) -> DataFrame:
    """Adds rank by (score to PLACES places desc, doc_id asc) and keeps rank <= k; scores that are equal to PLACES places tie."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_scores(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the cosine of each of ``pairs(query_id, doc_id)``, as in ``dense_topk``."""
    d, q = vectors.select("doc_id", F.col("v").alias("dv")), queries.select("query_id", F.col("v").alias("qv"))
    both = pairs.select("query_id", "doc_id").join(d, "doc_id").join(q, "query_id")
    return both.select("query_id", "doc_id", cosine(F.col("dv"), F.col("qv")).alias("score"))


def by_width(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each width; key -1 holds the places of vectors that are null or hold null."""
    lists = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    width = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    if lists.flatten().null_count:
        holes = pc.list_parent_indices(lists).to_numpy()[pc.is_null(lists.flatten()).to_numpy(zero_copy_only=False)]
        width = width.copy()
        width[holes] = -1
    out = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False) if w > 0 else np.zeros(0)
        out[w] = at, flat.astype(np.float64).reshape(len(at), max(w, 0))
    return out


def in_order(rows: np.ndarray) -> np.ndarray:
    """Sums of the rows, from the first component to the last."""
    total = np.zeros(len(rows))
    for t in range(rows.shape[1]):
        total += rows[:, t]
    return total


def summed(q: np.ndarray, q_norm: np.ndarray, d: np.ndarray, d_norm: np.ndarray, at: np.ndarray, to: np.ndarray, k: int) -> Iterator[tuple]:
    """(places of queries, places of candidates, cosines) of the pairs (at, to), summed component by component; of equal
    cosines of a query the k smallest places are kept."""
    for cut in range(0, len(at), SCORES):
        i, j = at[cut : cut + SCORES], to[cut : cut + SCORES]
        total = np.zeros(len(i))
        for t in range(q.shape[1]):
            total += d[j, t] * q[i, t]
        exact = total / (d_norm[j] * q_norm[i])
        order = np.lexsort((j, -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        yield i[place < k], j[place < k], exact[place < k]


def block_topk(q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, include_self: bool) -> Iterator[tuple]:
    """(places of queries, places of candidates, cosines) that hold every candidate of this block that is among a query's k best.

    A matrix product finds what lies within SLACK of a query's k-th best score, and those alone are summed component by
    component, so that scores do not depend on the library or the block. Of equal scores the k smallest ids are kept.
    ``d_ids`` ascend.
    """
    q_norm, d_norm = np.sqrt(in_order(q * q)), np.sqrt(in_order(d * d))
    if not (np.all(q_norm) and np.all(d_norm)):
        raise ValueError("a vector of norm 0 has no cosine")
    q_unit, d_unit = q / q_norm[:, None], d / d_norm[:, None]
    own = lambda side: np.searchsorted(d_ids, q_ids, side) if not include_self else np.zeros(len(q_ids), int)
    first, last = own("left"), own("right")
    step = max(1, SCORES // max(1, len(d_ids)))
    for start in range(0, len(q_ids), step):
        some = slice(start, start + step)
        scores = q_unit[some] @ d_unit.T
        for row, i, j in zip(scores, first[some], last[some]):
            row[i:j] = -np.inf
        if k < len(d_ids):
            least = np.partition(scores, len(d_ids) - k, axis=1)[:, len(d_ids) - k]
            at, to = np.nonzero(~(scores < least[:, None] - SLACK) & (scores != -np.inf))
        else:
            at, to = np.nonzero(scores != -np.inf)
        yield from summed(q, q_norm, d, d_norm, at + start, to, k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine of ``vectors(doc_id, v)`` and ``queries(query_id, v)``; exact.

    Every pair is scored, so the work is queries x candidates. Vectors that are null, hold null or have another width than
    the query have no score and come last; a norm of 0 fails the job.
    """
    return nearest(block_scores(vectors, queries, k, include_self).withColumn("score", F.col("score").cast(EXACT)), k)


def block_scores(vectors: DataFrame, queries: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score) that hold the k best of each query, for ``dense_topk``.

    Both sides are dealt into blocks of bounded size, and each pair of blocks is one group, which keeps k per query. Groups
    are few bytes and much work, so they are dealt to a number of partitions that adaptive execution does not coalesce.
    """
    n_q = queries.count()
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    rows = max(256, min(CANDIDATE_BLOCK, BLOCK_CELLS // max(1, size["width"] or 1)))
    gq, gd = -(-n_q // BROADCAST_QUERIES) or 1, max(-(-size["n"] // rows), min(24, -(-size["n"] // 512))) or 1
    dealt = lambda blocks: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = queries.select("query_id", F.col("v").alias("qv")).withColumn("_gq", dealt(gq)).withColumn("_gd", every(gd))
    d = vectors.select("doc_id", F.col("v").alias("dv")).withColumn("_gd", dealt(gd)).withColumn("_gq", every(gq))
    if not include_self:
        q, d = q.where("query_id is not null"), d.where("doc_id is not null")
    q, d = (side.repartition(SPREAD * gq * gd, "_gq", "_gd") for side in (q, d))

    kinds = {f.name: f.dataType for f in (queries.schema["query_id"], vectors.schema["doc_id"])}
    empty = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kinds.items()), ("score", pa.float64())]).empty_table()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return empty
        right = right.sort_by("doc_id")
        q_ids, d_ids = left["query_id"].to_numpy(), right["doc_id"].to_numpy()
        candidates, parts = by_width(right["dv"]), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]
        for width, (at, matrix) in by_width(left["qv"]).items():
            same, others = candidates.get(width, (np.zeros(0, int), np.zeros((0, 0)))) if width > 0 else (np.zeros(0, int), np.zeros((0, 0)))
            for i, j, s in block_topk(q_ids[at], matrix, d_ids[same], others, k, include_self) if len(same) else ():
                parts.append((at[i], same[j], s, np.zeros(len(i), bool)))
            rest = np.setdiff1d(np.arange(len(d_ids)), same)
            for i in at if len(rest) else ():
                last = rest if include_self else rest[d_ids[rest] != q_ids[i]]
                parts.append((np.full(len(last[:k]), i), last[:k], np.zeros(len(last[:k])), np.ones(len(last[:k]), bool)))
        i, j, s, none = (np.concatenate(c) for c in zip(*parts))
        return pa.table([left["query_id"].take(pa.array(i)), right["doc_id"].take(pa.array(j)), pa.array(s, mask=none)], ["query_id", "doc_id", "score"])

    return q.groupBy("_gq", "_gd").cogroup(d.groupBy("_gq", "_gd")).applyInArrow(
        score, ", ".join([*(f"{name} {kind.simpleString()}" for name, kind in kinds.items()), "score double"])
    )
