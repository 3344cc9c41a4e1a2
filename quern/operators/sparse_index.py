"""A frozen sparse index: numbered vocabulary, collection statistics and a fingerprint, kept beside its collection.

Vectors made under one index can be compared only with vectors made under it, so texts that come later are encoded with
the statistics of the index, not with their own: terms it does not know are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .ingest import require
from .lexical import B, EXACT, K1, cut, idf, lengths, postings, query_terms, statistics, vocabulary, weight

SCHEMA = "quern-sparse-index-v1"


@dataclass(frozen=True)
class SparseIndex:
    """``terms(term, term_index, df, idf)`` and one row of ``stats``."""

    terms: DataFrame
    stats: DataFrame


def numbered(terms: DataFrame) -> DataFrame:
    """Adds ``term_index``, the place of ``term`` (unique) in the order of code points, from 0.

    Terms are numbered within their first character and moved by the counts of the characters before it, so that no
    task orders the whole vocabulary; the counts have one row a character.
    """
    head = terms.withColumn("_head", F.substring("term", 1, 1))
    sizes = head.groupBy("_head").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("_head", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_head").orderBy("term")) - 1
    return head.withColumn("_own", own).join(moved, "_head").withColumn("term_index", F.col("_before") + F.col("_own")).drop("_head", "_own", "_before")


def document_digest(ident: Column, text: Column) -> Column:
    """Hash of an id and a text, the id behind its length, so that no two pairs are spelt alike."""
    name = ident.cast("string")
    return F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, F.lit(":"), F.coalesce(text, F.lit(""))), 256)


def fingerprint(docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """One row (fingerprint): a digest of the parameters and of all documents in any order and partitioning.

    Each document's hash is read as four whole numbers, which are summed; repeated documents count each time.
    """
    digest = docs.select(document_digest(F.col("doc_id"), F.col("text")).alias("h"))
    word = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = digest.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(word(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)])
    parts = [F.lit(SCHEMA), F.lit(str(k1)), F.lit(str(b)), "n", *[F.col(f"s{i}").cast("string") for i in range(4)]]
    return sums.select(F.sha2(F.concat_ws(":", *parts), 256).alias("fingerprint"))


def build(docs: DataFrame, k1: float = K1, b: float = B, analyzer=None) -> SparseIndex:
    """The index of ``docs(doc_id, text)``; doc_ids are unique, a null text counts as empty, no documents make an empty
    vocabulary."""
    if not k1 >= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative, b must lie between 0 and 1")
    stats = statistics(lengths(docs, analyzer))
    count = stats.select("n")
    terms = numbered(vocabulary(postings(docs, analyzer))).crossJoin(F.broadcast(count))  # one row
    terms = terms.select("term", "term_index", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    marks = fingerprint(docs, k1, b)
    head = stats.crossJoin(F.broadcast(marks))  # one row each
    return SparseIndex(terms, head.select(F.lit(SCHEMA).alias("schema"), "fingerprint", "n", "avgdl", F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")))


def encode_documents(index: SparseIndex, docs: DataFrame, analyzer=None) -> DataFrame:
    """(doc_id, term_index, weight) of any ``docs(doc_id, text)`` under the index's statistics.

    A document's length counts all its terms, known or not. Documents without known terms have no rows.
    """
    terms = cut(docs, analyzer).select("doc_id", F.size("g").alias("dl"), F.explode("g").alias("term"))
    counted = terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    rows = counted.join(index.terms.select("term", "term_index", "idf"), "term").crossJoin(F.broadcast(index.stats.select("avgdl", "k1", "b")))  # one row
    value = F.col("idf") * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("k1"), F.col("b"))
    return rows.select("doc_id", "term_index", value.alias("weight"))


def encode_queries(index: SparseIndex, queries: DataFrame, analyzer=None) -> DataFrame:
    """(query_id, term_index) of the distinct known terms of ``queries(query_id, text)``; their weight is 1."""
    return query_terms(queries, analyzer).join(index.terms.select("term", "term_index"), "term").select("query_id", "term_index")


def inner_products(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of all pairs that share a term."""
    return documents.join(queries, "term_index").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight").cast(EXACT)).alias("score"))


def write(index: SparseIndex, path: str) -> None:
    """Terms first, statistics last: a folder without statistics is no index. Nothing is overwritten."""
    index.terms.write.parquet(f"{path}/terms")
    size = index.terms.sparkSession.read.parquet(f"{path}/terms").count()
    index.stats.withColumn("terms", F.lit(size)).write.json(f"{path}/stats")


STATS = "schema string, fingerprint string, n long, avgdl double, k1 double, b double, terms long"


def read(spark: SparkSession, path: str) -> SparseIndex:
    """A stored index; another schema, other statistics or an incomplete vocabulary are refused."""
    stats = spark.read.schema(STATS).option("mode", "FAILFAST").json(f"{path}/stats")
    terms = spark.read.schema("term string, term_index long, df long, idf double").parquet(f"{path}/terms")
    found = stats.collect()  # one row
    if len(found) != 1 or found[0]["schema"] != SCHEMA or any(v is None for v in found[0]):
        raise ValueError(f"{path}: not a {SCHEMA} folder")
    row = found[0]
    if row["n"] < 1 or not 0 < row["avgdl"] < float("inf"):
        raise ValueError(f"{path}: statistics out of range")
    got = terms.agg(F.count("*").alias("n"), F.max("term_index").alias("last"), F.count_if(~(F.col("idf") > 0)).alias("bad")).first()
    if got["n"] != row["terms"] or (got["n"] and got["last"] != got["n"] - 1) or got["bad"]:
        raise ValueError(f"{path}: vocabulary is not that of its statistics")
    return SparseIndex(terms, stats.drop("terms"))


def same_collection(index: SparseIndex, docs: DataFrame) -> DataFrame:
    """The index's statistics; the job fails if ``docs`` are not the documents it was built from."""
    k = index.stats.select("k1", "b").first()
    now = fingerprint(docs, k["k1"], k["b"]).withColumnRenamed("fingerprint", "_now")
    both = index.stats.crossJoin(F.broadcast(now))  # one row each
    return require(both, F.col("fingerprint") == F.col("_now"), "the collection changed since its index was built").drop("_now")
