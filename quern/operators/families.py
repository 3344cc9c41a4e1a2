"""Metrics by name and families of paired contrasts over ``scores(unit_id, cluster, arm, metric, value, ...)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import stats
from .ingest import require
from .lexical import EXACT
from .metrics import ideal_gain, judged_ranks

#: A metric is made from the sorted ranks of a query's relevant documents that the run holds, and their number in all.
Metric = Callable[[Column, Column], Column]


def _within(ranks: Column, k: int) -> Column:
    return F.filter(ranks, lambda r: r <= k)


def recall(k: int) -> Metric:
    return lambda ranks, n: F.size(_within(ranks, k)) / n


def hit(k: int) -> Metric:
    return lambda ranks, n: (F.size(_within(ranks, k)) > 0).cast("double")


def all_found(k: int) -> Metric:
    return lambda ranks, n: (F.size(_within(ranks, k)) == n).cast("double")


def reciprocal_rank(k: int) -> Metric:
    return lambda ranks, n: F.coalesce(1 / F.get(_within(ranks, k), F.lit(0)), F.lit(0.0))


def ndcg(k: int) -> Metric:
    gain = lambda ranks: F.aggregate(_within(ranks, k), F.lit(0.0), lambda s, r: s + 1 / F.log2(r.cast("double") + 1))
    return lambda ranks, n: gain(ranks) / ideal_gain(F.least(n, F.lit(k)))


DEFAULT: dict[str, Metric] = {"R@1": recall(1), "MRR@10": reciprocal_rank(10), "nDCG@10": ndcg(10)}


def score_queries(run: DataFrame, qrels: DataFrame, metrics: dict[str, Metric] | None = None) -> DataFrame:
    """(query_id, metric, value) of every judged query; one that the run does not answer has value 0."""
    return score_ranks(judged_ranks(run, qrels), F.count("*"), metrics)


def score_ranks(ranks: DataFrame, n_gold: Column, metrics: dict[str, Metric] | None = None) -> DataFrame:
    """``score_queries`` from ``ranks(query_id, rank)`` and the aggregate ``n_gold``, as for ``metrics.rank_metrics``."""
    chosen = DEFAULT if metrics is None else metrics
    found = ranks.groupBy("query_id").agg(F.sort_array(F.collect_list("rank")).alias("r"), n_gold.alias("n"))
    rows = [F.struct(F.lit(name).alias("metric"), f(F.col("r"), F.col("n")).cast("double").alias("value")) for name, f in chosen.items()]
    return found.select("query_id", F.explode(F.array(*rows)).alias("m")).select("query_id", "m.metric", "m.value")


def evaluate(run: DataFrame, qrels: DataFrame, metrics: dict[str, Metric] | None = None, **options) -> DataFrame:
    """(metric, mean, low, high, n): the named metrics over all judged queries with seeded bootstrap intervals."""
    return evaluate_scores(score_queries(run, qrels, metrics), **options)


def evaluate_scores(scores: DataFrame, **options) -> DataFrame:
    """``evaluate`` from ``scores(query_id, metric, value)``."""
    rows = scores.select("metric", F.col("query_id").alias("unit_id"), F.lit(None).cast("string").alias("cluster"), "value")
    return stats.bootstrap_table(rows, ["metric"], **options)


def contrasts(scores: DataFrame, keys: list[str], comparisons: Sequence[tuple[str, str]]) -> DataFrame:
    """(keys..., metric, comparator, treatment, unit_id, cluster, before, after) of all compared arms; a unit that one
    arm lacks, or holds twice, fails the job."""
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("comparator"), F.lit(b).alias("treatment")) for a, b in comparisons]))
    role = lambda c: F.when(F.col("arm") == F.col(c), F.col("value"))
    rows = scores.withColumn("_c", both).select("*", "_c.comparator", "_c.treatment").where("arm in (comparator, treatment)")
    units = rows.groupBy(*keys, "metric", "comparator", "treatment", "unit_id").agg(
        F.max("cluster").alias("cluster"), F.max(role("comparator")).alias("before"), F.max(role("treatment")).alias("after"), F.count("*").alias("_n"),
    )
    paired = (F.col("_n") == 2) & F.col("before").isNotNull() & F.col("after").isNotNull()
    return require(units, paired, "arms were not scored on the same units").drop("_n")


def tallies(paired: DataFrame, keys: list[str]) -> DataFrame:
    """Mean difference, wins, losses and ties per contrast, without any resampling."""
    b, a = F.col("before"), F.col("after")
    return paired.groupBy(*keys, "metric", "comparator", "treatment").agg(
        F.count("*").alias("units"), (F.sum((a - b).cast(EXACT)) / F.count("*")).cast("double").alias("delta"), F.count_if(a > b).alias("wins"),
        F.count_if(a < b).alias("losses"), F.count_if((a == b) & (a == 0)).alias("ties_zero"), F.count_if((a == b) & (a != 0)).alias("ties_nonzero"),
    )


def paired_family(
    scores: DataFrame, keys: list[str], comparisons: Sequence[tuple[str, str]], *, binary: bool, resamples: int = 10_000, alpha: float = 0.05
) -> DataFrame:
    """One corrected row per contrast: tallies, interval of the difference, p, adjusted p, whether it is rejected and
    whether p and adjusted p rest on the resampling floor.

    Binary metrics take the exact McNemar test, others the paired bootstrap; all contrasts are one Holm family. The
    units of one contrast (queries) meet in one group, in order of unit_id, which is what the seeded draws need.
    """
    paired = contrasts(scores, keys, comparisons)
    by = [*keys, "metric", "comparator", "treatment"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paired.select(*by).schema)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit_id", kind="stable")
        before, after = pdf["before"].tolist(), pdf["after"].tolist()
        clusters = None if pdf["cluster"].isna().all() else pdf["cluster"].tolist()
        ci = stats.bootstrap_ci([t - b for b, t in zip(before, after)], clusters, resamples=resamples)
        if binary:
            p = stats.mcnemar_exact(sum(b > 0 and not t > 0 for b, t in zip(before, after)), sum(t > 0 and not b > 0 for b, t in zip(before, after)))
        else:
            p = stats.paired_bootstrap_p(before, after, clusters, resamples=resamples)
        at_floor = not binary and p <= stats.p_floor(resamples) + 1e-12
        return pd.DataFrame([dict(zip(by, key)) | {"low": ci["low"], "high": ci["high"], "p": p, "at_floor": at_floor}])

    tested = paired.groupBy(*by).applyInPandas(run, f"{fields}, low double, high double, p double, at_floor boolean")
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    named = tested.withColumn("name", name).withColumn("family", F.lit("family"))
    corrected = stats.holm(named.select("family", "name", "p"), alpha).select("name", "adjusted", "reject")

    def floors(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = stats.holm_floor_flags({n: (p, bool(f)) for n, p, f in zip(pdf["name"], pdf["p"], pdf["at_floor"])})
        return pd.DataFrame({"name": list(flags), "adjusted_at_floor": list(flags.values())})

    marked = named.select("family", "name", "p", "at_floor").groupBy("family").applyInPandas(floors, "name string, adjusted_at_floor boolean")
    return tallies(paired, keys).join(named.drop("family"), by).join(corrected, "name").join(marked, "name").drop("name")


def interaction(scores: DataFrame, baseline: str, alternative: str) -> DataFrame:
    """(unit_id, cluster, value): how much more ``alternative`` gains over ``baseline`` on the paraphrase than on the
    direct question of each unit of ``scores(unit_id, cluster, variant, arm, value)``; all four values must be there."""
    cell = lambda v, a: F.max(F.when((F.col("variant") == v) & (F.col("arm") == a), F.col("value")))
    wide = scores.where(F.col("arm").isin(baseline, alternative)).groupBy("unit_id").agg(
        F.max("cluster").alias("cluster"), cell("direct", baseline).alias("bd"), cell("direct", alternative).alias("ad"),
        cell("paraphrase", baseline).alias("bp"), cell("paraphrase", alternative).alias("ap"),
    )
    value = (F.col("ap") - F.col("bp")) - (F.col("ad") - F.col("bd"))
    return require(wide, value.isNotNull(), "a unit lacks one of its four scores").select("unit_id", "cluster", value.alias("value"))
