"""Corpus pipeline: quality rules, line dedup, n-gram join, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.common import Stages, read_table
from quern.llm.line_dedup import dedup_lines
from quern.llm.mixing import label_domains, resample
from quern.llm.ngram_join import keep_one
from quern.llm.packing import pack_documents
from quern.llm.quality import quality_filter

#: Token shares of the domains after mixing; the amount is that at which high quality text keeps its tokens.
MIX = {"high": 0.95, "low": 0.05, "toxic": 0.0}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed and the adaptive rules.

    Null and empty texts have too few words and go. Null language and source are groups of their own, equal rows have equal
    verdicts, very long texts are read whole, an empty table gives none, and other columns pass through.
    """
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; a document all of whose lines repeat goes. n_chars follows.

    A null text has no lines and stays null; so does an empty one. Of rows equal in all columns one keeps its lines. Lines of
    any length are compared whole; an empty table gives none, and other columns pass through.
    """
    out = dedup_lines(docs).where((F.size("dropped") == 0) | (F.trim("text") != ""))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Null and empty texts are copies of nothing and stay. Of rows equal in all columns one stays. Texts of any length are
    compared whole; an empty table gives none, and other columns pass through.
    """
    return keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: toxic ones go, clean ones stay.

    Null and empty texts hold no tokens and go by their domain's rate. Equal rows are dealt alike; very long texts count whole;
    without labels or documents the rates are 1, and other columns pass through.
    """
    return resample(docs, label_domains(read_table(spark, sf_dir, "labels")), MIX, "high")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    A null or empty text is its closing id alone. Equal rows are pieces each, long texts are cut into as many as they need,
    an empty table gives none; other columns are not read.
    """
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: SQL can express neither the tokenizer nor the fitted rates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written and read again."""
    tables = Stages(spark, "pipeline")
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = tables.table(stage(spark, docs, sf_dir))
        if last is not None:
            tables.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
