"""Ranking metrics over ``runs(query_id, rank, doc_id)`` and ``qrels(query_id, doc_id, grade)``.

Every judged query appears in every result: a query that a run does not answer scores 0. Ranks are positions from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lexical import EXACT
from .fusion import rank_bucket


def exact_mean(value: Column) -> Column:
    """Mean whose sum does not depend on the order of rows."""
    return (F.sum(value.cast(EXACT)) / F.count(value)).cast("double")


def judged_ranks(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade, rank) of every relevant document, rank null where the run lacks it."""
    gold = qrels.where(F.col("grade") > 0).select("query_id", "doc_id", "grade")
    best = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return gold.join(best, ["query_id", "doc_id"], "left")


def _discount(rank: Column) -> Column:
    return 1 / F.log2(rank.cast("double") + 1)


def ideal_gain(count: Column) -> Column:
    """Discounts of the first ``count`` ranks."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + _discount(i))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row per judged query: n_gold, recall@1, recall@k, hit@1, hit@k, all@k, mrr@k and binary ndcg@k."""
    return rank_metrics(judged_ranks(run, qrels), F.count("*"), k)


def rank_metrics(ranks: DataFrame, n_gold: Column, k: int = 10) -> DataFrame:
    """``per_query`` from ``ranks(query_id, rank)`` of relevant documents. Those that the run lacks may be left out where the
    aggregate ``n_gold`` counts them otherwise; a query without any other has a row with a null rank."""
    within = F.col("rank") <= k
    wide = ranks.groupBy("query_id").agg(
        n_gold.alias("n_gold"), F.count(F.when(F.col("rank") <= 1, 1)).alias("h1"), F.count(F.when(within, 1)).alias("hk"),
        F.min(F.when(within, F.col("rank"))).alias("first"),
        F.sum(F.when(within, _discount(F.col("rank")).cast(EXACT))).alias("dcg"),
    )
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return wide.select(
        "query_id", "n_gold", (F.col("h1") / F.col("n_gold")).alias("recall_1"), (F.col("hk") / F.col("n_gold")).alias("recall_k"),
        flag(F.col("h1") > 0).alias("hit_1"), flag(F.col("hk") > 0).alias("hit_k"), flag(F.col("hk") == F.col("n_gold")).alias("all_k"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_k"),
        F.coalesce(F.col("dcg").cast("double") / ideal_gain(F.least(F.col("n_gold"), F.lit(k))), F.lit(0.0)).alias("ndcg_k"),
    )


METRICS = ("recall_1", "recall_k", "hit_1", "hit_k", "all_k", "mrr_k", "ndcg_k")


def graded_ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): gain 2^grade - 1, the ideal from the sorted grades."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    j = judged_ranks(run, qrels)
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), F.asc("doc_id"))
    placed = j.withColumn("ideal", F.row_number().over(w))
    return placed.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, (gain * _discount(F.col("rank"))).cast(EXACT))).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, (gain * _discount(F.col("ideal"))).cast(EXACT))).alias("best"),
    ).select("query_id", (F.coalesce(F.col("dcg"), F.lit(0)).cast("double") / F.col("best").cast("double")).alias("ndcg"))


def graded_ndcg_of(ranks: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """``graded_ndcg`` from ``ranks(query_id, grade, rank)`` of the relevant documents of the run, and the number of those of
    each grade, ``grades(query_id, grade, n)``."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    w = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    placed = grades.withColumn("before", before).where(F.col("before") < k).select(
        "query_id", "grade", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k)))).alias("ideal")
    )
    best = placed.groupBy("query_id").agg(F.sum((gain * _discount(F.col("ideal"))).cast(EXACT)).alias("best"))
    dcg = ranks.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum((gain * _discount(F.col("rank"))).cast(EXACT)).alias("dcg"))
    ndcg = F.coalesce(F.col("dcg"), F.lit(0)).cast("double") / F.col("best").cast("double")
    return best.join(dcg, "query_id", "left").select("query_id", ndcg.alias("ndcg"))


def arity_report(metrics: DataFrame) -> DataFrame:
    """Means of the metrics by number of relevant documents."""
    return metrics.groupBy("n_gold").agg(F.count("*").alias("queries"), *[exact_mean(F.col(m)).alias(m) for m in METRICS])


def win_loss_tie(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """Counts over ``(unit_id, value)`` rows joined by unit: wins, losses, ties at zero and ties above it."""
    both = baseline.select("unit_id", F.col("value").alias("b")).join(treatment.select("unit_id", F.col("value").alias("t")), "unit_id")
    return both.agg(
        F.count_if(F.col("t") > F.col("b")).alias("wins"), F.count_if(F.col("t") < F.col("b")).alias("losses"),
        F.count_if((F.col("t") == F.col("b")) & (F.col("b") == 0)).alias("ties_zero"),
        F.count_if((F.col("t") == F.col("b")) & (F.col("b") != 0)).alias("ties_nonzero"),
        (F.count_if((F.col("t") > 0) | (F.col("b") > 0)) / F.count("*")).alias("union_rate"),
    )


def contingency(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """2 x 2 table of hits and the phi coefficient, 0 where a margin is empty."""
    both = baseline.select("unit_id", (F.col("value") > 0).alias("b")).join(treatment.select("unit_id", (F.col("value") > 0).alias("t")), "unit_id")
    c = both.agg(
        F.count_if(F.col("b") & F.col("t")).alias("both_hit"), F.count_if(F.col("b") & ~F.col("t")).alias("only_baseline"),
        F.count_if(~F.col("b") & F.col("t")).alias("only_treatment"), F.count_if(~F.col("b") & ~F.col("t")).alias("neither"),
    )
    a, b, d, e = (F.col(x).cast("double") for x in ("both_hit", "only_baseline", "only_treatment", "neither"))
    den = F.sqrt((a + b) * (d + e) * (a + d) * (b + e))
    return c.withColumn("phi", F.when(den == 0, 0.0).otherwise((a * e - b * d) / den))


def first_gold_buckets(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Share of judged queries by the bucket of their first relevant rank."""
    return rank_buckets(judged_ranks(run, qrels))


def rank_buckets(ranks: DataFrame) -> DataFrame:
    """``first_gold_buckets`` from ``ranks(query_id, rank)``, a row with a null rank for a query whose run holds none."""
    first = ranks.groupBy("query_id").agg(F.min("rank").alias("first"))
    total = first.agg(F.count("*").alias("n"))
    return (
        first.groupBy(F.coalesce(rank_bucket(F.col("first")), F.lit(">100")).alias("bucket")).agg(F.count("*").alias("queries"))
        .crossJoin(F.broadcast(total)).select("bucket", "queries", (F.col("queries") / F.col("n")).alias("share"))  # one row
    )


def retrieval_outcome(run: DataFrame, qrels: DataFrame, near: int = 10, far: int = 100) -> DataFrame:
    """(query_id, outcome): success, ranking_failure (found beyond ``near``) or recall_failure (not within ``far``)."""
    return rank_outcome(judged_ranks(run, qrels), near, far)


def rank_outcome(ranks: DataFrame, near: int = 10, far: int = 100) -> DataFrame:
    """``retrieval_outcome`` from ``ranks(query_id, rank)``, a row with a null rank for a query whose run holds none."""
    first = ranks.groupBy("query_id").agg(F.min("rank").alias("first"))
    return first.select(
        "query_id", F.when(F.col("first") <= near, "success").when(F.col("first") <= far, "ranking_failure").otherwise("recall_failure").alias("outcome")
    )


OUTCOMES = ("success", "ranking_failure", "recall_failure")


def bad_cases(outcomes: DataFrame) -> DataFrame:
    """Counts and rates per system of ``outcomes(system, query_id, outcome)``, zero-filled."""
    return outcomes.groupBy("system").agg(
        F.count("*").alias("queries"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        *[(F.count_if(F.col("outcome") == o) / F.count("*")).alias(f"{o}_rate") for o in OUTCOMES],
    )
