"""Places and order statistics of tables that no task sees whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.sources.staging import Staging

#: Values of a group that one window orders; larger groups are narrowed down first.
DIRECT = 10_000
#: Splitters of a round: every round leaves about one SPLITTERS-th of a group's values.
SPLITTERS = 64


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in the order of the columns, nulls first; equal rows in any order.

    Rows are dealt by ranges and sorted within; a place is that in its range plus the sizes of the ranges before, of which
    the driver has one number a task.
    """
    staging = Staging(rows.sparkSession, "numbered")
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = staging.table(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    starts, before = [], 0
    for p, n in sorted(map(tuple, placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())):
        starts.append((p, before))
        before += n
    sizes = rows.sparkSession.createDataFrame(starts, "_part long, _before long")  # one row a task
    at = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")
    return placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(name, at).drop("_part", "_before", "_at")


def _upto(part: list[str], order: str) -> Column:
    """Running sum of ``c`` before this row."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("c").over(w), F.lit(0))


def select_ranks(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., j, value): the value at rank ``k`` (from 0, ascending) among the ``value`` of ``rows`` with the keys, for each
    of ``targets(keys..., j, k)``. Exact, with ties.

    A group of up to DIRECT values is counted by value and ordered in one window. In a larger one splitters from a quantile
    sketch cut its values into ranges, the ranges are counted, and only the range that holds the rank goes on, so that no task
    sees a group's values whole; that the sketch is approximate costs a round at most. Null values do not count, null keys
    are groups of their own, and ranks beyond a group have no row.
    """
    staging = Staging(rows.sparkSession, "ranks")
    rows = rows.where("value is not null").select(F.struct(*keys).alias("g"), "value")
    kind = rows.schema["value"].dataType
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    none = F.lit(None).cast(kind)
    open_ = staging.table(
        targets.select(F.struct(*keys).alias("g"), "j", F.col("k").cast("long").alias("k")).join(sizes, "g").where("k >= 0 and k < n")
        .withColumn("lo", none).withColumn("hi", none)
    )
    found = []

    def inside(some: DataFrame) -> DataFrame:
        met = rows.join(F.broadcast(some) if some.count() <= DIRECT else some, "g")
        return met.where((F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") < F.col("hi"))))

    while True:
        few = inside(open_.where(F.col("n") <= DIRECT)).groupBy("g", "j", "k", "value").agg(F.count("*").alias("c"))
        placed = few.withColumn("before", _upto(["g", "j"], "value"))
        found.append(placed.where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c"))).select("g", "j", "value"))
        many = staging.table(open_.where(F.col("n") > DIRECT))
        if many.isEmpty():
            break
        points = F.percentile_approx("value", F.array(*[F.lit(i / SPLITTERS) for i in range(1, SPLITTERS)]), F.lit(20 * SPLITTERS))
        cut = inside(many).groupBy("g", "j").agg(F.array_distinct(points).alias("s"))
        cut = staging.table(many.join(cut, ["g", "j"]))
        # even: between two splitters, odd: equal to one; splitters are values, so that every round leaves some behind
        at = F.size(F.filter("s", lambda x: x < F.col("value"))) + F.size(F.filter("s", lambda x: x <= F.col("value")))
        ranges = inside(cut).groupBy("g", "j", "k", at.alias("r")).agg(
            F.count("*").alias("c"), F.min("value").alias("least"), F.max("value").alias("most")
        )
        held = staging.table(
            ranges.withColumn("before", _upto(["g", "j"], "r")).where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c")))
        )
        found.append(held.where("least = most").select("g", "j", F.col("least").alias("value")))
        narrowed = held.where("least < most").join(cut.select("g", "j", "s", "lo", "hi"), ["g", "j"])
        open_ = staging.table(narrowed.select(
            "g", "j", (F.col("k") - F.col("before")).alias("k"), F.col("c").alias("n"),
            F.coalesce(F.get("s", (F.col("r") / 2 - 1).cast("int")), "lo").alias("lo"), F.coalesce(F.get("s", (F.col("r") / 2).cast("int")), "hi").alias("hi"),
        ))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("g.*", "j", "value")


def _targets(rows: DataFrame, keys: list[str], ranks) -> DataFrame:
    """(keys..., n, j, k): ``ranks(n)`` gives the ranks as columns."""
    sizes = rows.where("value is not null").groupBy(*keys).agg(F.count("*").alias("n")) if keys else rows.where("value is not null").agg(F.count("*").alias("n"))
    return sizes.select(*keys, "n", F.posexplode(F.array(*ranks(F.col("n")))).alias("j", "k"))


def nearest_percentiles(rows: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys..., n, values): per quantile the value at min(floor(n q), n - 1) of ``rows(keys..., value)`` in order."""
    targets = _targets(rows, keys, lambda n: [F.least(F.floor(n * F.lit(q)), n - 1) for q in quantiles])
    return _gathered(select_ranks(rows, targets, keys), targets, keys)


def linear_percentiles(rows: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys..., n, values): per quantile the value interpolated between the ranks around q (n - 1)."""
    both = lambda n: [r for q in quantiles for r in (F.floor((n - 1) * F.lit(q)), F.ceil((n - 1) * F.lit(q)))]
    ends = _gathered(select_ranks(rows, _targets(rows, keys, both), keys), _targets(rows, keys, both), keys)
    at = lambda i, q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    value = lambda i: F.col("values")[i].cast("double")
    return ends.withColumn("values", F.array(*[value(2 * i) + (value(2 * i + 1) - value(2 * i)) * at(i, q) for i, q in enumerate(quantiles)]))


def _gathered(found: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with the values in the order of j; a group has as many as there are quantiles."""
    lists = found.select(F.struct(*keys).alias("g"), "j", "value").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("v"))
    sizes = targets.where("j = 0").select(F.struct(*keys).alias("g"), "n")
    return sizes.join(lists, "g").select("g.*", "n", F.col("v.value").alias("values"))
