"""Checks that several inputs cover the same keys, before they are joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: Faults that an error names.
NAMED = 5


def cover_faults(universe: DataFrame, inputs: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, input, fault, times): what keeps the inputs from holding every key of ``universe(key)`` exactly once.

    Faults: ``missing``, ``repeated``, ``extra`` (not in the universe) and ``empty`` (a null or empty key). One pass over the
    tagged keys of all inputs and one grouping; a key that fails in several inputs has a row for each. The universe is a set.
    """
    tagged = [universe.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("input")).distinct()]
    tagged += [df.select(F.col(key).alias("key"), F.lit(name).alias("input")) for name, df in inputs.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    counts = [F.count_if(F.col("input") == name).alias(name) for name in inputs]
    met = rows.groupBy("key").agg(F.count_if(F.col("input").isNull()).alias("_known"), *counts)
    each = met.select("key", "_known", F.explode(F.array(*[F.struct(F.lit(n).alias("input"), F.col(n).alias("times")) for n in inputs])).alias("e"))
    bare = F.col("key").isNull() | (F.col("key").cast("string") == "")
    fault = (
        F.when(bare & (F.col("e.times") > 0), "empty").when(bare, None).when((F.col("_known") == 0) & (F.col("e.times") > 0), "extra")
        .when((F.col("_known") > 0) & (F.col("e.times") == 0), "missing").when((F.col("_known") > 0) & (F.col("e.times") > 1), "repeated")
    )
    return each.select(F.col("key").alias(key), "e.input", fault.alias("fault"), "e.times").where("fault is not null")


def strict_join(universe: DataFrame, inputs: dict[str, DataFrame], key: str) -> DataFrame:
    """The rows of all inputs joined on ``key``, one row per key of the universe; columns other than the key are named
    ``input.column``. Fails before the join, naming faults, unless each input holds every key exactly once. The check is a
    job of its own, which no later outer join can optimise away."""
    faults = cover_faults(universe, inputs, key)
    found = faults.orderBy("input", "fault", F.col(key).cast("string")).limit(NAMED).collect()
    if found:
        raise ValueError("inputs do not cover the keys: " + "; ".join(f"{r['input']}: {r['fault']} {r[key]!r} ({r['times']} times)" for r in found))
    out = universe.select(key).distinct()
    for name, df in inputs.items():
        out = out.join(df.select(key, *[F.col(c).alias(f"{name}.{c}") for c in df.columns if c != key]), key)
    return out


def product_faults(trials: DataFrame, tasks: DataFrame, methods: list[str]) -> DataFrame:
    """(task, method, fault, times): what keeps ``trials(task, method)`` from holding every task with every method once.

    The product is not built: a task's methods are counted, one column a method. ``unknown_task`` and ``unknown_method`` name
    trials of neither list.
    """
    known = tasks.select("task").distinct()
    listed = F.col("method").isin(methods)
    strange = trials.where(~F.coalesce(listed, F.lit(False))).groupBy("task", "method").agg(F.count("*").alias("times"))
    wide = known.withColumn("_known", F.lit(True)).join(
        trials.where(listed).groupBy("task").agg(*[F.count_if(F.col("method") == m).alias(m) for m in methods]), "task", "full_outer"
    )
    each = wide.select(
        "task", "_known", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.coalesce(m, F.lit(0)).alias("times")) for m in methods])).alias("e")
    )
    fault = (
        F.when(F.col("_known").isNull() & (F.col("e.times") > 0), "unknown_task").when(F.col("_known").isNull(), None)
        .when(F.col("e.times") == 0, "missing").when(F.col("e.times") > 1, "repeated")
    )
    out = each.select("task", "e.method", fault.alias("fault"), "e.times").where("fault is not null")
    return out.unionByName(strange.select("task", "method", F.lit("unknown_method").alias("fault"), "times"))
