"""Character n-gram BM25: postings, statistics, sparse vectors and exact search.

Scores are accumulated as DECIMAL(18,10): the sum is associative, so a ranking does not depend on how rows were
partitioned. Ties go to the smaller id. Queries are sets of terms, documents multisets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.text import char_ngrams

K1, B = 1.5, 0.75
EXACT = "decimal(18,10)"
#: Query terms are broadcast up to this many rows; beyond it the postings are joined by a shuffle on the term.
BROADCAST_TERMS = 500_000


def cut(docs: DataFrame, analyzer=None) -> DataFrame:
    """(doc_id, g): the grams of ``docs(doc_id, text)``, dealt by doc_id.

    The text is shuffled once, which is less than its grams; whatever groups or joins by doc_id stays in its task.
    """
    grams = (analyzer or (lambda c: char_ngrams(c, 2)))(F.col("text"))
    return docs.select("doc_id", "text").repartition("doc_id").select("doc_id", grams.alias("g"))


def postings(docs: DataFrame, analyzer=None) -> DataFrame:
    """(doc_id, term, tf) of ``docs(doc_id, text)``."""
    return cut(docs, analyzer).select("doc_id", F.explode("g").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, analyzer=None) -> DataFrame:
    """(doc_id, dl): terms of each document, 0 where it has none."""
    return cut(docs, analyzer).groupBy("doc_id").agg(F.sum(F.size("g")).cast("long").alias("dl"))


def statistics(dl: DataFrame) -> DataFrame:
    """One row (n, avgdl); avgdl is 1 for a collection without terms."""
    return dl.agg(F.count("*").alias("n"), F.sum("dl").alias("terms")).select(
        "n", F.when(F.coalesce("terms", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("terms") / F.col("n")).alias("avgdl")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, df)."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def sparse_vectors(posts: DataFrame, dl: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, term, weight): document-side BM25 weights, to be summed over a query's terms."""
    stats = statistics(dl)
    return (
        posts.join(vocabulary(posts), "term").join(dl, "doc_id").crossJoin(F.broadcast(stats))  # one row
        .select("doc_id", "term", (idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("weight"))
    )


def query_terms(queries: DataFrame, analyzer=None) -> DataFrame:
    """(query_id, term): distinct terms."""
    grams = (analyzer or (lambda c: char_ngrams(c, 2)))(F.col("text"))
    return queries.select("query_id", F.explode(F.array_distinct(grams)).alias("term"))


def top_k(scored: DataFrame, k: int, partition: str = "query_id", ident: str = "doc_id") -> DataFrame:
    """Adds rank by (score desc, id asc) and keeps rank <= k; Spark limits each group before the shuffle."""
    w = Window.partitionBy(partition).orderBy(F.desc("score"), F.asc(ident))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Documents scored at once against all queries, and queries whose scores are held at once.
SCORE_ROWS, SCORE_QUERIES = 256, 4096
#: Weights are whole numbers of 1 / UNIT while they are summed: sums below 2**53 are exact in any order.
UNIT = 10**10


class TopScores:
    """The k best documents of every query among those added, by (score desc, id asc)."""

    def __init__(self, k: int, n_queries: int):
        self.k = k
        self.best: list[list[tuple[float, object]]] = [[] for _ in range(n_queries)]

    def add(self, ids: list, scores: np.ndarray, first: int) -> None:
        """``scores`` [document, query] of queries from number ``first`` on; only positive ones count."""
        for j in range(scores.shape[1]):
            column, best = scores[:, j], self.best[first + j]
            at = np.flatnonzero(column >= (best[-1][0] if len(best) == self.k else 1))
            if len(at) > self.k:
                at = at[column[at] >= np.partition(column[at], -self.k)[-self.k]]
            if len(at):
                best += [(column[i], ids[i]) for i in at]
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[self.k :]


def sparse_search(vectors: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by inner product of document weights and binary queries.

    Up to BROADCAST_TERMS query terms go to every task, where a document's terms are added up for all queries at once
    and the best k a query are kept; only those are shuffled. With more terms, weights and terms are joined by a shuffle.
    """
    whole = F.round(F.col("weight").cast(EXACT) * UNIT).cast("long")
    score = lambda c: (F.col(c).cast("decimal(18,0)") * F.lit(Decimal(1) / UNIT)).cast("decimal(28,10)").alias("score")
    if terms.count() > BROADCAST_TERMS:
        summed = vectors.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(whole).alias("s"))
        return top_k(summed.select("query_id", "doc_id", score("s")), k)
    wanted = defaultdict(list)
    for r in terms.select("query_id", "term").distinct().orderBy("query_id").collect():
        wanted[r["term"]].append(r["query_id"])
    queries = sorted({q for found in wanted.values() for q in found})
    place = {q: i for i, q in enumerate(queries)}
    lists = {t: np.array([place[q] for q in found], np.int64) for t, found in wanted.items()}
    kinds = {f.name: f.dataType.simpleString() for f in (terms.schema["query_id"], vectors.schema["doc_id"])}
    types = [to_arrow_type(terms.schema["query_id"].dataType), to_arrow_type(vectors.schema["doc_id"].dataType), pa.int64()]
    few = vectors.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    rows = few.groupBy("doc_id").agg(F.collect_list(F.struct("term", whole.alias("w"))).alias("t")).select("doc_id", "t.term", "t.w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, held_ids, held = TopScores(k, len(queries)), [], []

        def score_held() -> None:
            for first in range(0, len(queries), SCORE_QUERIES):
                n = min(SCORE_QUERIES, len(queries) - first)
                table = np.zeros((len(held), n))
                for row, (at, weights) in zip(table, held):
                    inside = (at >= first) & (at < first + n) if n < len(queries) else slice(None)
                    row += np.bincount(at[inside] - first, weights[inside], n)
                top.add(held_ids, table, first)
            held_ids.clear()
            held.clear()

        for batch in batches:
            for doc, words, weights in zip(*(c.to_pylist() for c in batch.columns)):
                found = [lists[x] for x in words]
                held_ids.append(doc)
                held.append((np.concatenate(found), np.repeat(np.array(weights, float), [len(x) for x in found])))
                if len(held) == SCORE_ROWS:
                    score_held()
        score_held()
        out = [(q, doc, int(s)) for q, best in zip(queries, top.best) for s, doc in best]
        if out:
            q, doc, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((q, doc, s), types)], ["query_id", "doc_id", "s"])

    scored = rows.mapInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, s long")
    return top_k(scored.select("query_id", "doc_id", score("s")), k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, analyzer=None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best documents with a positive score.

    Only postings of query terms are counted: documents are filtered to the queries' vocabulary before the shuffle;
    N and lengths come from all documents.
    """
    terms = query_terms(queries, analyzer)
    few = terms.count() <= BROADCAST_TERMS
    wanted = terms.select("term").distinct()
    side = F.broadcast if few else (lambda x: x)
    base = cut(docs, analyzer)
    dl = base.groupBy("doc_id").agg(F.sum(F.size("g")).cast("long").alias("dl"))
    posts = (
        base.select("doc_id", F.explode("g").alias("term")).join(side(wanted), "term", "left_semi")
        .groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    )
    return sparse_search(sparse_vectors(posts, dl, k1, b), terms, k).where("score > 0")
