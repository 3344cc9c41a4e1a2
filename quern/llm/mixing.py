"""Soft-membership mixing of documents to target domain weights, with DataFrame functions only."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Stages, read_table
from .quality import bind

#: The classifier: naive Bayes on tokens hashed into BUCKETS, present or absent, fitted on about SAMPLE labelled
#: documents. Only buckets that SUPPORT of them hold, whose counts by domain differ significantly,
#: and which some domain holds LIFT times as often as the others do, are features: common words would only tell the length.
BUCKETS, SAMPLE, SUPPORT, SIGNIFICANT, LIFT = 1 << 17, 30_000, 5, 30.0, 3.5
#: Relative miss that is met; relative gradient at which the targets are as near as they can be; weight of the rates'
#: distance from one beside the misses; rounds at most. A miss that stays is reported.
TOLERANCE, KKT, RIDGE, ROUNDS = 1e-3, 1e-7, 1e-6, 200
#: The bucket that every document has; rows of labels or of scores (a few numbers each) that may be broadcast.
START, BROADCAST_ROWS = BUCKETS, 1_000_000
DOMAINS = ("high", "low", "toxic")
WEIGHTS = {"high": 0.85, "low": 0.15, "toxic": 0.0}

#: What lies between words (letters, digits and all beyond ASCII) and between runs of ASCII signs. Java matches listed
#: ranges more than ten times as fast as their complement.
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN_SIGNS = r"[\x00-\x20\x30-\x39\x41-\x5A\x61-\x7A\x7F-\x{10FFFF}]+"


def tokens(text: Column) -> Column:
    """The words and the runs of signs of a whole text in lower case, with repeats. Splits are linear in the text; extracting matches is not."""
    value = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.concat(F.split(value, _BETWEEN_WORDS), F.split(value, _BETWEEN_SIGNS)), "")


def bucket_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """(*keep, n, b): a row for each token of ``rows(*keep, text)`` and one with the bucket START, n being the number of tokens."""
    parts = rows.select(*keep, tokens(F.col("text")).alias("_parts"))
    each = parts.select(*keep, F.size("_parts").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit("")), "_parts")).alias("x"))
    return each.select(*keep, "n", F.when(F.col("x") == "", F.lit(START)).otherwise(F.pmod(F.xxhash64("x"), F.lit(BUCKETS)).cast("int")).alias("b"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: toxic, else high or low quality. Rows without doc_id or labels go."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))


def fit_classifier(stages: Stages, rows: DataFrame, labelled: DataFrame, domains: tuple[str, ...], sample: int = SAMPLE) -> tuple[list[float], DataFrame]:
    """(log odds without any feature, features) from ``rows(doc_id, text)``; a hash sample of about ``sample`` labelled rows is read.

    Features are rows (b, e0, ...): a bucket and the evidence of its presence for each domain, in thousandths. There are
    at most BUCKETS and one, START without evidence. Without labelled rows all domains are alike.
    """
    count = labelled.count()
    some = labelled if count <= sample else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * sample / count)
    some = F.broadcast(some) if min(count, 2 * sample) <= BROADCAST_ROWS else some
    known = rows.join(some.where(F.col("domain").isin(*domains)), "doc_id").withColumn("_at", F.monotonically_increasing_id())
    present = bucket_rows(known, "_at", "domain").select("_at", "domain", "b").distinct()
    k = range(len(domains))
    tally = stages.table(present.groupBy("b").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)]))
    start = tally.where(F.col("b") == START).first()
    sizes = [1 + (start[f"n{i}"] if start else 0) for i in k]
    total = sum(sizes)
    n, q = [F.col(f"n{i}") for i in k], [(F.col(f"n{i}") + 1) / (sizes[i] + 2) for i in k]
    share = sum(n[1:], n[0]) / total
    differs = sum([F.pow(n[i] - sizes[i] * share, 2) / (sizes[i] * share + 1) for i in k], F.lit(0.0))
    others = [(sum(n[1:], n[0]) - n[i] + 1) / (total - sizes[i] + 2) for i in k]
    found = tally.where((F.col("b") != START) & (sum(n[1:], n[0]) >= SUPPORT) & (differs >= SIGNIFICANT) & (F.array_max(F.array(*[q[i] / others[i] for i in k])) >= LIFT))
    milli = lambda x: F.round(1000 * x).cast("long")
    features = stages.table(found.select("b", *[milli(F.log(q[i] / (1 - q[i]))).alias(f"e{i}") for i in k], *[milli(F.log(1 - q[i])).alias(f"a{i}") for i in k]))
    absent = features.agg(*[F.sum(f"a{i}") for i in k]).first()
    return [math.log(x / total) + (a or 0) / 1000 for x, a in zip(sizes, absent)], features.select("b", *[f"e{i}" for i in k])


def softmax(logits: list[Column]) -> Column:
    return bind(F.array(*logits), lambda s: bind(
        F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    ))


def score_rows(rows: DataFrame, absent: list[float], features: DataFrame) -> DataFrame:
    """(_row, _t, e0, ...) of ``rows(_row, text)``: tokens and summed evidence of the different features.

    The features are broadcast (at most BUCKETS rows of k numbers); tokens that are none go before any exchange.
    """
    names = [f"e{i}" for i in range(len(absent))]
    start = features.sparkSession.range(1).select(F.lit(START).alias("b"), *[F.lit(0).cast("long").alias(x) for x in names])
    hits = bucket_rows(rows, "_row").join(F.broadcast(features.union(start)), "b").distinct()
    return hits.groupBy("_row").agg(F.max("n").alias("_t"), *[F.sum(x).alias(x) for x in names])


def rate_of(p: Column, lift: list[float]) -> Column:
    """The rate of a document with probabilities ``p``. The numbers are one constant, so that every round runs the same code."""
    return F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, F.lit(np.array(lift, float)), lambda x, y: x * y), F.lit(1.0), lambda a, x: a + x))


def fit_rates(rows: DataFrame, weights: list[float], anchor: int) -> tuple[list[float], list[float]]:
    """(lift, relative miss by domain) of the rates max(0, 1 + lift . _p) fitted to ``rows(_p: array of k probabilities, _t: tokens)``.

    Minimises the squared relative errors of the expected domain totals sum(rate * _t * _p) against the targets over
    rates >= 0, and among such rates the squared distance from one, weighted by tokens. Rates of that form are the
    optimum for a ``lift`` that minimises a convex function of k variables. Its gradient is the miss of the projected
    rates; steps along it are scaled by the k * k curvature (damped Newton steps), since plain gradient steps take
    thousands of rounds where a domain is rare against its weight. A round is one aggregation of k * k + k + 1 sums.
    Rounds end when all targets are met within TOLERANCE, at the optimum when no rates >= 0 meet them, or after ROUNDS.
    """
    k = len(weights)

    def sums(lift: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p, r = [F.col("_p")[i] for i in range(k)], F.col("rate")
        mass = F.when(r > 0, F.col("_t")).otherwise(0.0)
        got = rows.withColumn("rate", rate_of(F.col("_p"), lift.tolist())).agg(
            F.sum(F.col("_t") * r * r), *[F.sum(F.col("_t") * r * x) for x in p], *[F.sum(mass * x * y) for x in p for y in p]
        ).first()
        got = np.array([x or 0.0 for x in got])
        return got[0], got[1 : k + 1], got[k + 1 :].reshape(k, k)

    lift = np.zeros(k)
    square, now, gram = sums(lift)
    target = now[anchor] / weights[anchor] * np.array(weights)
    scale = np.maximum(np.maximum(now, target), 1.0)
    ridge = RIDGE * scale**2 / max(now.sum(), 1.0)
    value = lambda square, x: square / 2 - x @ target + ridge @ (x * x) / 2
    best, step, move = value(square, lift), 1.0, None
    for _ in range(ROUNDS):
        if move is None:
            slope = now - target + ridge * lift
            if ((now - target) ** 2 / scale**2).sum() < TOLERANCE**2 or np.abs(slope / scale).max() < KKT:
                break
            outer = np.outer(scale, scale)
            move, step = np.linalg.solve((gram + np.diag(ridge)) / outer, -slope / scale) / scale, 1.0
        square, there, bent = sums(lift + step * move)
        tried = value(square, lift + step * move)
        if tried <= best + 1e-4 * step * (slope @ move) + 1e-12 * abs(best):
            lift, best, now, gram, move = lift + step * move, tried, there, bent, None
        else:
            step /= 2
    return lift.tolist(), ((now - target) / scale).tolist()


def mix_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str, with_text: bool = False) -> DataFrame:
    """``docs`` plus ``posteriors`` (array in the order of ``weights``), ``tokens``, ``rate`` and ``copies``.

    A classifier fitted on ``labelled(doc_id, domain)`` gives each document its domain probabilities; its tokens are
    the words and runs of signs of its whole text. The rates make the expected tokens of the domains meet ``weights``, the amount being
    that at which the domain ``anchor`` keeps its own tokens. ``copies`` is the rate rounded to a whole number without
    bias, by a hash of doc_id and text. Rows are staged once with their numbers, and read once for the probabilities;
    documents with equal evidence are one row for the rounds. Targets that no rates meet within TOLERANCE are reported
    by a warning.

    Null and empty text: prior probabilities and no tokens. Null doc_id: no label. Labels of unknown documents are
    unused. Repeated rows are documents of their own with equal results. Very long texts are read whole. An empty table
    gives no rows. Other columns pass through, whatever their names, but input columns named like a result give way.
    """
    stages = Stages(docs.sparkSession, "mixing")
    domains = tuple(weights)
    k = range(len(domains))
    own = [c for c in docs.columns if c not in ("text", "posteriors", "tokens", "rate", "copies")]
    rows = stages.table(docs.select(F.struct(*own).alias("_doc"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row")))
    absent, features = fit_classifier(stages, rows.select("_doc.doc_id", "text"), labelled, domains)
    scores = stages.table(score_rows(rows.select("_row", "text"), absent, features))
    names = [f"e{i}" for i in k]
    p = softmax([F.col(x) / 1000.0 + a for x, a in zip(names, absent)])
    alike = stages.table(scores.groupBy(*names).agg(F.sum("_t").cast("double").alias("_t")).select("_t", p.alias("_p")))
    lift, miss = fit_rates(alike, [weights[d] for d in domains], domains.index(anchor))
    if math.hypot(*miss) >= TOLERANCE:
        shares = ", ".join(f"{d} {x:+.3%}" for d, x in zip(domains, miss))
        warnings.warn(f"source mixing misses its token targets (relative to the larger of start and target): {shares}")
    some = F.broadcast(scores) if scores.count() <= BROADCAST_ROWS else scores
    draw = F.xxhash64("_doc.doc_id", "text").alias("_draw")
    joined = rows.select("_row", "_doc", draw, *(["text"] if with_text else [])).join(some, "_row").withColumn("_p", p).withColumn("_rate", rate_of(F.col("_p"), lift))
    return joined.select(
        "_doc.*", *(["text"] if with_text else []), F.col("_p").alias("posteriors"), F.col("_t").alias("tokens"), F.col("_rate").alias("rate"),
        copies(F.col("_rate"), F.col("_draw")).alias("copies"),
    )


def copies(rate: Column, draw: Column) -> Column:
    """Whole copies of a document: the rate rounded by a hash, without bias; one for rates that are one within TOLERANCE."""
    u = F.pmod(F.xxhash64(draw), F.lit(1 << 30)) / float(1 << 30)
    return F.when(F.abs(rate - 1) <= TOLERANCE, F.lit(1)).otherwise(F.floor(rate + u).cast("int"))


def domain_totals(mixed: DataFrame, weights: dict[str, float], anchor: str) -> DataFrame:
    """(domain, target, fitted, dealt): token totals of ``mixed(posteriors, tokens, rate, copies)`` from mix_rates, by rate and by copies."""
    part = mixed.select(F.posexplode("posteriors").alias("i", "p"), "tokens", "rate", "copies").select(
        "i", (F.col("p") * F.col("tokens")).alias("t"), "rate", "copies"
    )
    totals = part.groupBy("i").agg(F.sum("t").alias("start"), F.sum(F.col("t") * F.col("rate")).alias("fitted"), F.sum(F.col("t") * F.col("copies")).alias("dealt"))
    at = list(weights).index(anchor)
    amount = F.broadcast(totals.where(F.col("i") == at).select((F.col("start") / weights[anchor]).alias("_amount")))
    names, shares = F.array(*map(F.lit, weights)), F.array(*[F.lit(float(w)) for w in weights.values()])
    return totals.join(amount, F.lit(True)).select(
        names[F.col("i")].alias("domain"), (shares[F.col("i")] * F.col("_amount")).alias("target"), "fitted", "dealt"
    )


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str) -> DataFrame:
    """``docs`` with each row as often as mix_rates says; its columns keep their names and values.

    Null and empty text, null doc_id, repeated rows and empty tables: as in mix_rates.
    """
    whole = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_all"), "doc_id", "text")
    mixed = mix_rates(whole, labelled, weights, anchor, with_text=True).where("copies > 0")
    return mixed.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col("text") if c == "text" else F.col("_all")[c].alias(c) for c in docs.columns]
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = label_domains(read_table(spark, sf_dir, "labels"))
    mixed = mix_rates(docs, labelled, WEIGHTS, "high")
    return mixed.select(
        "doc_id", "tokens", *[F.round(F.col("posteriors")[i], 6).alias(f"p_{d}") for i, d in enumerate(WEIGHTS)],
        F.round("rate", 6).alias("rate"), "copies",
    )
