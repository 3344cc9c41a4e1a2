"""Vector index: k-means cells as partitions of a table, probes as an equi-join on the cell, and a check of what a plan reads."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.sources.staging import Staging

from .dense import BLOCK_CELLS, BROADCAST_QUERIES, CANDIDATE_BLOCK, SCORES, SLACK as NEAR, SPREAD, in_order, nearest as nearest_k, summed
from .lexical import EXACT

#: Cells at most (their centroids are broadcast), training vectors per cell, and rounds of training.
MAX_CELLS, SAMPLE_PER_CELL, ROUNDS = 4096, 256, 8
#: Probed (query, cell) rows that are broadcast to the vectors of their queries; more are joined by a shuffle on the query.
BROADCAST_PROBES = 20_000
#: Queries on which the number of probes is chosen.
CALIBRATION_QUERIES = 200
#: Slack of angles and cosines, far above the error of doubles.
SLACK = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal widths as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a direction: not null, finite, norm above 0."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def nearest(centroids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cosine) of each row; of equal cosines the smaller cell."""
    cosines = unit(rows) @ centroids.T if len(rows) else np.zeros((0, len(centroids)))
    cell = cosines.argmax(1) if len(rows) else np.zeros(0, int)
    return cell, cosines[np.arange(len(rows)), cell]


def train(vectors: DataFrame, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centroids of ``cells`` cells or fewer of ``vectors(doc_id, v)``.

    Spherical k-means on a hash sample of about SAMPLE_PER_CELL vectors a cell, drawn from all rows. Every round is one pass
    over the staged sample: tasks add up their vectors by cell, and the sums of a cell meet in one row. It starts from the
    different sampled vectors with the smallest hashes.
    """
    staging = Staging(vectors.sparkSession, "ann-train")
    n = vectors.count()
    share = min(1.0, cells * SAMPLE_PER_CELL / max(n, 1))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    sample = staging.table(vectors.where(F.pmod(draw, F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("v", draw.alias("h")))
    first = sample.groupBy("v").agg(F.min("h").alias("h")).orderBy("h").limit(cells).collect()
    centroids = unit(np.array([r["v"] for r in first], float)) if first else np.zeros((0, 1))
    for _ in range(rounds if len(first) > 1 else 0):
        sent = sample.sparkSession.sparkContext.broadcast(centroids)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            total, count = np.zeros(known.shape), np.zeros(len(known), np.int64)
            for batch in batches:
                rows = matrix(batch.column(0))
                cell, _ = nearest(known, rows)
                np.add.at(total, cell, unit(rows))
                count += np.bincount(cell, minlength=len(known))
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met].tolist(), pa.list_(pa.float64()))], ["cell", "total"])

        def whole(table: pa.Table) -> pa.Table:
            total = matrix(table.column("total")).sum(0)
            return pa.table({"cell": table.column("cell")[:1], "total": pa.array([total.tolist()], pa.list_(pa.float64()))})

        schema = "cell long, total array<double>"
        moved = centroids.copy()
        for r in sample.select("v").mapInArrow(partial, schema).groupBy("cell").applyInArrow(whole, schema).collect():
            if any(r["total"]):
                moved[r["cell"]] = unit(np.array([r["total"]]))[0]
        sent.unpersist()
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    staging.drop(sample)
    return centroids


@dataclass
class VectorIndex:
    """A stored index: ``centroids`` by cell, and each cell's ``rows`` and ``radius`` (its widest angle to the centroid)."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    schema: str

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/cells")


def build(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS, seed: int = 0) -> VectorIndex:
    """Writes the index of ``vectors(doc_id, v)`` to ``path``: every usable row in the partition of its cell, then the cells.

    The square root of the number of rows is the number of cells unless ``cells`` is given. Rows are dealt by cell and cells
    with many rows are split (a rebalance, not a hash), so that a cell that holds a third of all rows is many files.
    """
    spark, good = vectors.sparkSession, usable(vectors.select("doc_id", "v"))
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(good.count()))))
    centroids = train(good, cells, rounds, seed)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, cosine = nearest(sent.value, matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.clip(cosine, -1, 1))], ["doc_id", "v", "cell", "cosine"]
            )

    kinds = dict(good.dtypes)
    placed = good.mapInArrow(assign, f"doc_id {kinds['doc_id']}, v {kinds['v']}, cell int, cosine double")
    placed.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/cells")
    schema = f"doc_id {kinds['doc_id']}, v {kinds['v']}, cosine double, cell int"
    sizes = spark.read.schema(schema).parquet(f"{path}/cells").groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect()
    known = {r["cell"]: (r["n"], math.acos(r["least"])) for r in sizes}
    rows = [(i, c.tolist(), *known.get(i, (0, 0.0))) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>, n long, radius double").coalesce(1).write.parquet(f"{path}/centroids")
    spark.createDataFrame([(schema,)], "schema string").coalesce(1).write.json(f"{path}/schema")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index; a folder without its schema is none, as that is written last."""
    schema = spark.read.schema("schema string").json(f"{path}/schema").first()["schema"]
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["cell"])
    return VectorIndex(
        spark, path, np.array([r["centroid"] for r in rows]).reshape(len(rows), -1 if rows else 0), np.array([r["n"] for r in rows], np.int64),
        np.array([r["radius"] for r in rows], float), schema,
    )


def probes(index: VectorIndex, queries: DataFrame, count: int) -> DataFrame:
    """(query_id, cell, place): the ``count`` cells whose centroids are nearest to each query of ``queries(query_id, v)``."""
    sent = index.spark.sparkContext.broadcast((index.centroids, index.rows > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, filled = sent.value
        for batch in batches if len(centroids) else []:
            cosines = np.where(filled, unit(matrix(batch.column("v"))) @ centroids.T, -2.0)
            best = np.argsort(-cosines, axis=1, kind="stable")[:, : min(count, int(filled.sum()))]
            ids = batch.column("query_id").take(pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1])))
            place = np.tile(np.arange(best.shape[1], dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.ravel().astype(np.int32)), pa.array(place)], ["query_id", "cell", "place"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "v").mapInArrow(run, f"query_id {kind}, cell int, place int")


def probes_for(index: VectorIndex, queries: DataFrame, k: int, target: float, include_self: bool = False) -> int:
    """The least number of probes at which a share ``target`` of the k nearest vectors lies in probed cells, as measured by
    exact search on the CALIBRATION_QUERIES queries with the smallest hashes."""
    some = Staging(index.spark, "ann-calibrate").table(usable(queries).orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION_QUERIES))
    best = search_exact(index, some, k, max(1, len(index.rows) // 8), include_self)
    order = probes(index, some, len(index.rows))
    hits = best.join(index.table().select("doc_id", "cell"), "doc_id").join(order, ["query_id", "cell"])
    sizes = sorted(map(tuple, hits.groupBy("place").agg(F.count("*")).collect()))  # one row a place, MAX_CELLS at most
    total, upto = sum(n for _, n in sizes), 0
    for place, n in sizes:
        upto += n
        if upto >= target * total:
            return place + 1
    return max(1, len(index.rows))


def farther_cells(index: VectorIndex, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, cell): cells that may hold a vector at least as near as the k-th of ``found(query_id, cell, score)``.

    ``found`` has an array of the cells read and the k-th score, null where there are fewer. A member of a cell is no nearer
    than the angle to the centroid less the cell's radius.
    """
    sent = index.spark.sparkContext.broadcast((index.centroids, index.rows > 0, index.radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, filled, radius = sent.value
        for batch in batches if len(centroids) else []:
            angle = np.arccos(np.clip(unit(matrix(batch.column("v"))) @ centroids.T, -1, 1))
            bound = np.cos(np.maximum(angle - radius - SLACK, 0)) + SLACK
            out_q, out_c = [], []
            for i, (seen, score) in enumerate(zip(batch.column("cells").to_pylist(), batch.column("score").to_pylist())):
                may = filled & (bound[i] >= (-2.0 if score is None else score))
                may[seen or []] = False
                out_c.append(np.flatnonzero(may))
                out_q.append(np.full(len(out_c[-1]), i))
            ids = batch.column("query_id").take(pa.array(np.concatenate(out_q)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(out_c).astype(np.int32))], ["query_id", "cell"])

    joined = queries.join(found, "query_id", "left").select("query_id", "v", "cells", F.col("score").cast("double"))
    kind = dict(queries.dtypes)["query_id"]
    return joined.mapInArrow(run, f"query_id {kind}, cell int")


def scan(index: VectorIndex, cells: list[int]) -> DataFrame:
    """The rows of some cells, by a filter on the partition column."""
    return index.table().where(F.col("cell").isin(cells) if cells else F.lit(False))


def deal(index: VectorIndex, cells: list[int]) -> list[tuple[int, int, int]]:
    """(cell, block, pieces): blocks of about equal numbers of rows, several cells each or a piece of one large cell, whose
    pieces are the blocks from ``block`` on."""
    total, width = int(index.rows[cells].sum()), max(1, index.centroids.shape[1])
    most = max(256, min(CANDIDATE_BLOCK, BLOCK_CELLS // width, max(512, -(-total // 24))))
    out, block, held = [], 0, 0
    for cell in cells:
        rows = int(index.rows[cell])
        pieces = -(-rows // most) or 1
        if held and held + rows > most:
            block, held = block + 1, 0
        out.append((cell, block, pieces))
        block, held = (block + pieces, 0) if pieces > 1 else (block, held + rows)
    return out


def cells_topk(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, asked: dict[int, np.ndarray], d_ids: np.ndarray, d: np.ndarray,
               held: np.ndarray, k: int, include_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, places of candidates, cosines) that hold every candidate that is among a query's k best of the cells
    it asks for, unless it is below ``least``.

    ``asked`` has the places of the queries by cell; ``held``, the candidates' cells, ascends, and their ids ascend in a cell. A
    matrix product by cell finds what lies within NEAR of a query's k-th best score so far; that alone is summed.
    """
    q_norm, d_norm = np.sqrt(in_order(q * q)), np.sqrt(in_order(d * d))
    if not (np.all(q_norm) and np.all(d_norm)):
        raise ValueError("a vector of norm 0 has no cosine")
    q_unit, d_unit = q / q_norm[:, None], d / d_norm[:, None]
    least, best = least.copy(), np.full((len(q), k), -np.inf)
    parts = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for cell, places in asked.items():
        lo, hi = np.searchsorted(held, [cell, cell + 1])
        step, few = max(1, SCORES // max(1, hi - lo)), min(k, hi - lo)
        for start in range(0, len(places) if few else 0, step):
            some = places[start : start + step]
            scores = q_unit[some] @ d_unit[lo:hi].T
            if not include_self:
                first, last = (np.searchsorted(d_ids[lo:hi], q_ids[some], side) for side in ("left", "right"))
                for at in np.flatnonzero(first < last):
                    scores[at, first[at] : last[at]] = -np.inf
            met = np.flatnonzero((scores >= least[some, None] - NEAR).any(1))
            some, scores = some[met], scores[met]
            top = np.partition(scores, hi - lo - few, axis=1)[:, hi - lo - few :]
            best[some] = np.partition(np.concatenate([best[some], top], axis=1), few, axis=1)[:, few:]
            least[some] = np.maximum(least[some], best[some].min(1))
            at, to = np.nonzero((scores >= least[some, None] - NEAR) & (scores != -np.inf))
            parts += summed(q, q_norm, d, d_norm, some[at], to + lo, k)
    i, j, exact = (np.concatenate(c) for c in zip(*parts))
    still = exact >= least[i] - NEAR
    return i[still], j[still], exact[still]


def scored(index: VectorIndex, queries: DataFrame, probed: DataFrame, k: int, include_self: bool, last: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) that hold the k best vectors of each query in the cells probed for it; ``probed`` is staged.

    ``last(query_id, score)``: scores below which a query needs no vectors. Cells are dealt into blocks of bounded size, and each
    pair of a block of queries and one of cells is one group, to which a query goes if it probes a cell there. Groups are dealt
    to a number of partitions that adaptive execution does not coalesce.
    """
    cells = sorted(r["cell"] for r in probed.select("cell").distinct().collect())
    dealt = deal(index, cells)
    blocks = max((block + pieces for _, block, pieces in dealt), default=1)
    gq = -(-queries.count() // BROADCAST_QUERIES) or 1
    at = F.broadcast(index.spark.createDataFrame(dealt, "cell int, _block int, _pieces int"))
    pieces = F.explode(F.expr("sequence(_block, _block + _pieces - 1)"))
    listed = probed.join(at, "cell").select("query_id", "cell", pieces.alias("_block")).groupBy("query_id", "_block").agg(F.collect_set("cell").alias("cells"))
    listed = F.broadcast(listed) if probed.count() <= BROADCAST_PROBES else listed
    asked = queries.select("query_id", F.col("v").alias("qv"))
    asked = asked.withColumn("least", F.lit(None).cast("double")) if last is None else asked.join(
        last.select("query_id", F.col("score").cast("double").alias("least")), "query_id", "left"
    )
    asked = asked.join(listed, "query_id").withColumn("_gq", F.pmod(F.xxhash64("query_id"), F.lit(gq)).cast("int"))
    piece = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_pieces")).cast("int")
    rows = scan(index, cells).select("cell", "doc_id", F.col("v").alias("dv")).join(at, "cell").select(
        "cell", "doc_id", "dv", (F.col("_block") + piece).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(gq - 1))).alias("_gq")
    )
    rows = rows if include_self else rows.where("doc_id is not null")
    asked, rows = (side.repartition(SPREAD * gq * blocks, "_gq", "_block") for side in (asked, rows))

    kinds = {"query_id": queries.schema["query_id"].dataType, "doc_id": rows.schema["doc_id"].dataType}
    empty = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kinds.items()), ("score", pa.float64())]).empty_table()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return empty
        right = right.take(pc.sort_indices(right, [("cell", "ascending"), ("doc_id", "ascending")], null_placement="at_start"))
        lists = left["cells"].combine_chunks()
        cell, place = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
        order = np.argsort(cell, kind="stable")
        known, starts = np.unique(cell[order], return_index=True)
        i, j, s = cells_topk(
            left["query_id"].to_numpy(), matrix(left["qv"]), left["least"].fill_null(-np.inf).to_numpy(),
            dict(zip(known.tolist(), np.split(place[order], starts[1:]))), right["doc_id"].to_numpy(), matrix(right["dv"]),
            right["cell"].to_numpy(), k, include_self,
        )
        return pa.table([left["query_id"].take(pa.array(i)), right["doc_id"].take(pa.array(j)), pa.array(s)], ["query_id", "doc_id", "score"])

    out = asked.groupBy("_gq", "_block").cogroup(rows.groupBy("_gq", "_block")).applyInArrow(
        score, ", ".join([*(f"{name} {kind.simpleString()}" for name, kind in kinds.items()), "score double"])
    )
    return out.withColumn("score", F.col("score").cast(EXACT))


def search(index: VectorIndex, queries: DataFrame, k: int, count: int, include_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest vectors by cosine in the ``count`` cells nearest to each query.

    Scores are those of ``dense_topk`` and equal ones go to the smaller id. Queries without direction have no rows.
    """
    staging, asked = Staging(index.spark, "ann-search"), usable(queries)
    probed = staging.table(probes(index, asked, count))
    return nearest_k(scored(index, asked, probed, k, include_self), k)


def search_exact(index: VectorIndex, queries: DataFrame, k: int, count: int, include_self: bool = False) -> DataFrame:
    """``search`` with a second round over every cell whose bound does not rule out a nearer vector: the result of an
    exact scan, reading the cells that can matter."""
    staging, asked = Staging(index.spark, "ann-exact"), usable(queries)
    probed = staging.table(probes(index, asked, count))
    near = staging.table(nearest_k(scored(index, asked, probed, k, include_self), k))
    seen = probed.groupBy("query_id").agg(F.collect_list("cell").alias("cells"))  # a query's cells, MAX_CELLS at most
    last = near.where(F.col("rank") == k).select("query_id", "score")
    more = staging.table(farther_cells(index, asked, seen.join(last, "query_id", "left"), k))
    both = near.select("query_id", "doc_id", "score").unionByName(scored(index, asked, more, k, include_self, last))
    return nearest_k(both, k)


def rows_read(index: VectorIndex, probed: DataFrame) -> DataFrame:
    """(query_id, cells, rows, share): what the probes of each query read, of all indexed rows."""
    sizes = index.spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.rows)], "cell int, n long")
    out = probed.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.count("*").alias("cells"), F.sum("n").alias("rows"))
    return out.withColumn("share", F.col("rows") / F.lit(int(index.rows.sum())))


def verify_plan(run: DataFrame, index: VectorIndex) -> set[int]:
    """The cells that the plan of ``run`` reads; fails unless each scan of the index is limited to some by its partition filter."""
    leaves = run._jdf.queryExecution().sparkPlan().collectLeaves()
    found: set[int] = set()
    scans = 0
    root = index.path.rstrip("/") + "/cells"
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if not leaf.getClass().getSimpleName().startswith("FileSourceScan"):
            continue
        location = leaf.relation().location()
        paths = location.rootPaths()
        if not any(paths.apply(j).toString().endswith(root.split("://")[-1]) for j in range(paths.size())):
            continue
        scans += 1
        filters = leaf.partitionFilters()
        known = filters.take(0)
        for j in range(filters.size()):
            if "dynamicpruning" not in filters.apply(j).toString():  # the others are known before the run
                known = known.appended(filters.apply(j))
        if known.isEmpty():
            raise RuntimeError("the plan reads all cells of the vector index")
        files = location.listFiles(known, known.take(0))
        found |= {files.apply(j).values().getInt(0) for j in range(files.size())}
    if not scans:
        raise RuntimeError("the plan does not read the vector index")
    return found
