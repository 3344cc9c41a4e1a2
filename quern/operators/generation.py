"""Text generation metrics: BLEU-4, ROUGE-L, token overlap, refusal sentinel and question-answer scores."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quern.functions.text import bind

from .metrics import exact_mean

# The refusal sentence, outer quotes and terminal punctuation that its normalisation removes.
SENTINEL = "无法推断"
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"), ("《", "》"))
TERMINAL = "。.!！?？;；,，…"


def _grams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), "\x1f"))
    )


def clipped_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of a short text's tokens; quadratic in the different ones."""
    count = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: F.aggregate(
        F.array_intersect(s["a"], s["b"]), F.lit(0), lambda acc, g: acc + F.least(count(s["a"], g), count(s["b"], g))
    ))


def bleu4(candidate: Column, reference: Column) -> Column:
    """Sentence BLEU-4 of two token arrays without smoothing: 0 if any order has no match."""

    def body(s: Column) -> Column:
        c, r = s["c"], s["r"]
        precisions = []
        for n in range(1, 5):
            total = F.size(c) - (n - 1)
            precisions.append(F.when(total < 1, 0.0).otherwise(clipped_overlap(_grams(c, n), _grams(r, n)) / total))
        logs = sum((F.log(p) for p in precisions[1:]), F.log(precisions[0]))
        brevity = F.when(F.size(c) >= F.size(r), 1.0).otherwise(F.exp(1 - F.size(r) / F.size(c)))
        return F.when(F.least(*precisions) == 0, 0.0).otherwise(brevity * F.exp(logs / 4))

    return F.when((F.size(candidate) < 1) | (F.size(reference) < 1), 0.0).otherwise(
        bind(F.struct(candidate.alias("c"), reference.alias("r")), body)
    )


def token_f1(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """(sample_id, precision, recall, f1) of ``(sample_id, token)`` rows, by multiset overlap of joined counts."""
    count = lambda df, name: df.groupBy("sample_id", "token").agg(F.count("*").alias(name))
    g, r = count(generated, "g"), count(reference, "r")
    overlap = g.join(r, ["sample_id", "token"]).groupBy("sample_id").agg(F.sum(F.least("g", "r")).alias("o"))
    total = lambda df, name: df.groupBy("sample_id").agg(F.count("*").alias(name))
    rows = total(generated, "ng").join(total(reference, "nr"), "sample_id").join(overlap, "sample_id", "left").withColumn("o", F.coalesce("o", F.lit(0)))
    p, q = F.col("o") / F.col("ng"), F.col("o") / F.col("nr")
    return rows.select("sample_id", p.alias("precision"), q.alias("recall"), F.when(F.col("o") == 0, 0.0).otherwise(2 * p * q / (p + q)).alias("f1"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows: one big-integer step per token of ``b``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(sample_id, precision, recall, f1) of ``pairs(sample_id, candidate, reference)`` token arrays."""
    kind = dict(pairs.dtypes)["sample_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for s, c, r in zip(f["sample_id"], f["candidate"], f["reference"]):
                c, r = list(c if c is not None else []), list(r if r is not None else [])
                n = lcs_length(c, r) if c and r else 0
                p, q = (n / len(c), n / len(r)) if n else (0.0, 0.0)
                out.append((s, p, q, 2 * p * q / (p + q) if n else 0.0))
            yield pd.DataFrame(out, columns=["sample_id", "precision", "recall", "f1"])

    return pairs.select("sample_id", "candidate", "reference").mapInPandas(run, f"sample_id {kind}, precision double, recall double, f1 double")


def sentinel_class(answer: str | None, sentinel: str = SENTINEL) -> str:
    """exact, normalized (NFKC, no white space, without outer quotes and terminal punctuation), near or none."""
    if not answer:
        return "none"
    if answer == sentinel:
        return "exact"
    text = "".join(unicodedata.normalize("NFKC", answer).split())
    opening, closing = ("".join(side) for side in zip(*QUOTES))
    around = re.fullmatch(f"([{re.escape(opening)}]*){re.escape(sentinel)}([{re.escape(closing + TERMINAL)}]*)", text)
    # quotes must close in the order in which they opened; terminal punctuation may stand anywhere between
    if around and around[1].translate(str.maketrans(opening, closing))[::-1] == "".join(c for c in around[2] if c not in TERMINAL):
        return "normalized"
    return "near" if sentinel in text else "none"


def classify_answers(rows: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """Adds ``sentinel`` to ``rows(answer, ...)``."""

    @F.pandas_udf("string")
    def classify(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sentinel_class(x, sentinel))

    return rows.withColumn("sentinel", classify("answer"))


def quest_report(rows: DataFrame) -> DataFrame:
    """Question-answer report of ``rows(reference_sentinel, generated_sentinel, f1)``: answerable questions, those
    answered, mean overlap of answered ones and over all answerable ones, null without any."""
    open_ = ~F.col("reference_sentinel").isin("exact", "normalized")
    answered = open_ & ~F.col("generated_sentinel").isin("exact", "normalized")
    total = F.coalesce(F.sum(F.when(answered, F.col("f1").cast("decimal(18,10)"))), F.lit(0))
    c = rows.agg(F.count("*").alias("questions"), F.count_if(open_).alias("answerable"), F.count_if(answered).alias("answered"), total.cast("double").alias("t"))
    return c.select(
        "questions", "answerable", "answered", F.expr("try_divide(answered, answerable)").alias("coverage"),
        F.expr("try_divide(t, answered)").alias("mean_f1_answered"), F.expr("try_divide(t, answerable)").alias("mean_f1_answerable"),
    )


def generation_report(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Means over all samples; a null or non-finite score rejects the report."""
    checked = [F.when(F.col(c).isNull() | F.isnan(c), F.raise_error(F.lit(f"invalid {c}")).cast("double")).otherwise(F.col(c)) for c in columns]
    return scores.agg(F.count("*").alias("samples"), *[exact_mean(x).alias(c) for x, c in zip(checked, columns)])
