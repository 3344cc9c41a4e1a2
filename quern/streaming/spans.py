"""Spans: trees by parent or by containment, and each span's own time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quern.operators.ingest import require
from quern.sources.staging import Staging


def nested(spans: DataFrame) -> DataFrame:
    """``spans(trace_id, span_id, start, end)`` with ``parent_id`` and ``depth``: the innermost span of the trace that holds it.

    A span holds another if it starts no later and ends no earlier; of equal spans the one with the smaller span_id holds the
    other. Spans that overlap without holding each other are neighbours. A trace's spans stream through one task in order
    of start, which keeps the chain of open spans only. A span that ends before it starts fails the job.
    """
    kinds = dict(spans.dtypes)
    rows = require(spans.select("trace_id", "span_id", "start", "end"), F.col("end") >= F.col("start"), "a span ends before it starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, chain, first = None, [], True
        for batch in batches:
            parents, depths = [], []
            for t, s, end in zip(*(batch.column(c).to_pylist() for c in ("trace_id", "span_id", "end"))):
                if first or t != trace:
                    trace, chain, first = t, [], False
                while chain and chain[-1][1] < end:
                    chain.pop()
                parents.append(chain[-1][0] if chain else None)
                depths.append(len(chain))
                chain.append((s, end))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(parents, batch.schema.field("span_id").type), pa.array(depths, pa.int32())],
                [*batch.schema.names, "parent_id", "depth"],
            )

    ordered = rows.repartition("trace_id").sortWithinPartitions("trace_id", "start", F.desc("end"), "span_id")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("trace_id", "span_id", "start", "end"))
    return ordered.mapInArrow(run, f"{schema}, parent_id {kinds['span_id']}, depth int")


def own_time(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, duration, children, own) of ``spans(trace_id, span_id, parent_id, start, end)``: own is the
    duration less the time in which at least one child runs, overlapping children counted once and cut to the parent."""
    kid = spans.where("parent_id is not null").select("trace_id", F.col("parent_id").alias("span_id"), F.col("start").alias("s"), F.col("end").alias("e"))
    of = spans.select("trace_id", "span_id", "start", "end")
    cut = kid.join(of, ["trace_id", "span_id"]).select(
        "trace_id", "span_id", F.greatest("s", "start").alias("s"), F.least("e", "end").alias("e")
    )
    before = Window.partitionBy("trace_id", "span_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("s", F.coalesce(F.max("e").over(before), "s"))
    busy = cut.withColumn("busy", F.greatest(F.col("e") - reach, F.lit(0))).groupBy("trace_id", "span_id").agg(
        F.count("*").alias("children"), F.sum("busy").alias("busy")
    )
    duration = F.col("end") - F.col("start")
    return of.join(busy, ["trace_id", "span_id"], "left").select(
        "trace_id", "span_id", duration.alias("duration"), F.coalesce("children", F.lit(0)).alias("children"),
        (duration - F.coalesce("busy", F.lit(0))).alias("own"),
    )


def tree(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, root_id, depth) by parent ids, by doubling: a round looks twice as far up. A span whose parent
    is unknown is a root; a cycle of parents fails."""
    staging = Staging(spans.sparkSession, "spans")
    own = spans.select("trace_id", "span_id", "parent_id")
    there = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_t"))
    up = own.join(there, ["trace_id", "parent_id"], "left").select(
        "trace_id", "span_id", F.when(F.col("_t"), F.col("parent_id")).alias("up"), F.when(F.col("_t"), 1).otherwise(0).cast("long").alias("depth")
    ).withColumn("root_id", F.coalesce("up", "span_id"))
    cur = staging.table(up)
    many = cur.count()
    while True:
        if cur.where("up is not null").isEmpty():
            return cur.select("trace_id", "span_id", "root_id", "depth")
        far = cur.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("root_id").alias("_r"))
        after = staging.table(cur.join(far, ["trace_id", "up"], "left").select(
            "trace_id", "span_id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
            F.coalesce("_r", "root_id").alias("root_id"),
        ))
        staging.drop(cur)
        cur = after
        if not cur.where(F.col("depth") > many).isEmpty():
            raise ValueError("parents form a cycle")
