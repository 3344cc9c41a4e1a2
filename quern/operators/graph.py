"""Graphs as tables of edges: connected components and the greedy independent set of an order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from quern.sources.staging import Staging

#: Rounds over all open edges before what is left is settled component by component.
ROUNDS = 6
#: Edges of a component that one task settles; larger ones go on by rounds.
COMPONENT_EDGES = 100_000


def components(edges: DataFrame, staging: Staging | None = None) -> DataFrame:
    """(id, component) of every vertex of ``edges(a, b)``; component is the smallest id reachable.

    Alternating large and small stars: each round links every vertex's larger, then all its, neighbours to the smallest one.
    A round is two grouped minima and two equi-joins, so the neighbours of a hub are never gathered, and the number of
    rounds grows with the logarithm of the longest path. Edges are staged after each round.
    """
    staging = staging or Staging(edges.sparkSession, "components")
    cur = staging.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        ways = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        first = up.groupBy("a").agg(F.min("b").alias("m"))
        hung = up.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        after = staging.table(hung.union(first.select("a", F.col("m").alias("b"))).distinct().observe(
            seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")
        ))
        staging.drop(cur)
        cur = after
        if seen.get == before:
            break
        before = seen.get
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).union(cur.select("b", "b").distinct())


def settle(edges: pd.DataFrame) -> pd.DataFrame:
    """(id, kept) of the vertices of one component, in order of id: one stays unless an earlier neighbour stays."""
    earlier: dict = {}
    for a, b in zip(edges["a"], edges["b"]):
        earlier.setdefault(b, []).append(a)
    kept: dict = {}
    for x in sorted(set(edges["a"]) | set(edges["b"])):
        kept[x] = not any(kept[a] for a in earlier.get(x, ()))
    return pd.DataFrame({"id": list(kept), "kept": list(kept.values())})


def greedy_independent(edges: DataFrame) -> DataFrame:
    """(id, kept) of the vertices of ``edges(a, b)``, as if they were taken in order of id and one stayed unless a neighbour
    that stayed came before it.

    A round decides every vertex whose earlier neighbours are all decided: one without any left stays, and its later
    neighbours go. Decided vertices leave the edges. Nothing is gathered at a hub; chains need a round for every second
    vertex, so after ROUNDS rounds components with up to COMPONENT_EDGES open edges are settled in a task each, by the
    sequential rule, and only larger ones go on by rounds. Repeated edges and loops do not matter.
    """
    spark = edges.sparkSession
    staging = Staging(spark, "greedy")
    every = staging.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    kind = dict(every.dtypes)["a"]
    open_, decided, rounds = every, [], 0
    while not open_.isEmpty():
        if rounds == ROUNDS:
            label = components(open_, staging)
            labelled = staging.table(open_.join(label.withColumnRenamed("id", "a"), "a"))
            large = labelled.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > COMPONENT_EDGES).select("component")
            within = labelled.join(large, "component", "left_anti")
            decided.append(staging.table(within.groupBy("component").applyInPandas(settle, f"id {kind}, kept boolean")))
            open_, rounds = staging.table(labelled.join(large, "component", "left_semi").select("a", "b")), 0
            continue
        first = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        first = staging.table(first)
        gone = staging.table(open_.join(first.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        left = open_.join(first.withColumnRenamed("id", "a"), "a", "left_anti")
        left = left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        decided += [first.withColumn("kept", F.lit(True)), gone.withColumn("kept", F.lit(False))]
        # a vertex all of whose earlier neighbours went, and whose later ones went too, has no edge left: it stays
        done, open_, rounds = open_, staging.table(left.select("a", "b")), rounds + 1
        if done is not every:
            staging.drop(done)
    out = every.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if not decided:
        return out.withColumn("kept", F.lit(True))
    known = decided[0]
    for d in decided[1:]:
        known = known.unionByName(d)
    return out.join(known, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def greedy_survivors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept, repeats) of all ``nodes(id)``: ``repeats`` is the smallest earlier neighbour that stays, null for one that stays."""
    staging = Staging(nodes.sparkSession, "survivors")
    pairs = staging.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"))
    state = staging.table(greedy_independent(pairs))
    stays = state.where("kept").select(F.col("id").alias("a"))
    why = pairs.join(stays, "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("repeats"))
    return (
        nodes.join(state, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))
        .join(why, "id", "left")
    )
