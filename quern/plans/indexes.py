"""Registered queries: the frozen sparse index, judgements and families of contrasts.

Pairs of questions are made from the benchmark: item i is the direct question of chunk i, and its paraphrase, numbered
after all items, asks for the same chunk. Documents stand for chunks and their source column for sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import families, judgements, sparse_index
from quern.operators.order import numbered

from .registry import query
from .retrieval import (
    DENSE, PER_QUERY, PREFIX, QRELS, QUERY_TERMS, TF, benchmark, dense_run, documents, label_ranks, labelled, staged_runs, table, two_runs, vectors,
)

TERMS = "WITH " + TF + """,
t AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_index, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, st)"""


def index(spark, sf_dir):
    return sparse_index.build(documents(spark, sf_dir))


@query(TERMS + " SELECT term, term_index, df, round(idf, 8) AS idf FROM t")
def sparse_index_terms(spark, sf_dir):
    return index(spark, sf_dir).terms.withColumn("idf", F.round("idf", 8))


@query("WITH " + TF + """,
h AS (SELECT sha256(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT count(*) AS n, """ + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS s{i}" for i in range(4)) + f""" FROM h)
SELECT sha256(concat_ws(':', '{sparse_index.SCHEMA}', '1.5', '0.75', s.n, s0, s1, s2, s3)) AS fingerprint, st.n, round(avgdl, 6) AS avgdl FROM s, st""")
def sparse_index_stats(spark, sf_dir):
    return index(spark, sf_dir).stats.select("fingerprint", "n", F.round("avgdl", 6).alias("avgdl"))


@query(TERMS + "," + QUERY_TERMS + " SELECT DISTINCT item_id AS query_id, term_index FROM qg JOIN t USING (term)")
def encode_query(spark, sf_dir):
    return sparse_index.encode_queries(index(spark, sf_dir), benchmark(spark, sf_dir))


@query(TERMS + "," + QUERY_TERMS + """,
bt AS (SELECT item_id, term, count(*) AS tf FROM qg GROUP BY ALL), bl AS (SELECT item_id, count(*) AS dl FROM qg GROUP BY 1)
SELECT item_id AS doc_id, term_index, round(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) AS weight FROM bt JOIN bl USING (item_id) JOIN t USING (term), st""")
def encode_document(spark, sf_dir):
    """Benchmark texts, which the index has not counted, under the documents' statistics."""
    later = benchmark(spark, sf_dir).withColumnRenamed("query_id", "doc_id")
    out = sparse_index.encode_documents(index(spark, sf_dir), later)
    return out.withColumn("weight", F.round("weight", 8))


METRIC_ROWS = """,
long_{run} AS (SELECT query_id, 'R@1' AS metric, recall_1 AS value FROM p_{run} UNION ALL SELECT query_id, 'MRR@10', mrr_k FROM p_{run}
  UNION ALL SELECT query_id, 'nDCG@10', ndcg_k FROM p_{run})"""
ONE = "WITH " + DENSE + PER_QUERY.format(run="dense") + METRIC_ROWS.format(run="dense")
BOTH = ONE + "," + PREFIX + PER_QUERY.format(run="prefix").replace(QRELS, "") + METRIC_ROWS.format(run="prefix")


@query(ONE + " SELECT metric, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18, 10))) / count(*) AS DOUBLE), 6) AS mean FROM long_dense GROUP BY 1")
def evaluate_run(spark, sf_dir):
    """Means of the named metrics; their seeded intervals are held against the function in tests."""
    ranks = label_ranks(spark, sf_dir, dense_run(spark, sf_dir))
    out = families.evaluate_scores(families.score_ranks(ranks, F.max("n_gold")), resamples=200)
    return out.select("metric", "n", F.round("mean", 6).alias("mean"))


def arm_scores(spark, sf_dir):
    parts = []
    for arm, width in (("dense", None), ("prefix", 16)):
        rows = families.score_ranks(label_ranks(spark, sf_dir, dense_run(spark, sf_dir, 100, width)), F.max("n_gold"))
        parts.append(rows.select(F.lit(arm).alias("arm"), "metric", F.col("query_id").alias("unit_id"), F.lit(None).cast("string").alias("cluster"), F.round("value", 8).alias("value")))
    return parts[0].unionByName(parts[1])


@query(BOTH + """,
u AS (SELECT metric, round(CAST(a.value AS DOUBLE), 8) AS b, round(CAST(d.value AS DOUBLE), 8) AS t FROM long_prefix a JOIN long_dense d USING (query_id, metric))
SELECT metric, 'prefix' AS comparator, 'dense' AS treatment, count(*) AS units, round(CAST(sum(CAST(t - b AS DECIMAL(18, 10))) / count(*) AS DOUBLE), 6) AS delta,
  count(*) FILTER (t > b) AS wins, count(*) FILTER (t < b) AS losses, count(*) FILTER (t = b AND t = 0) AS ties_zero, count(*) FILTER (t = b AND t <> 0) AS ties_nonzero
FROM u GROUP BY 1""")
def paired_tallies(spark, sf_dir):
    paired = families.contrasts(arm_scores(spark, sf_dir), [], [("prefix", "dense")])
    return families.tallies(paired, []).withColumn("delta", F.round("delta", 6))


@query()
def paired_family(spark, sf_dir):
    """Corrected contrasts with seeded intervals: no SQL; tests hold them against the plain functions."""
    return families.paired_family(arm_scores(spark, sf_dir), [], [("prefix", "dense")], binary=False, resamples=1000)


SWEEP = "WITH " + DENSE + ", " + """
c AS (SELECT query_id, 'label-' || label AS source, min(rank) AS rank FROM dense JOIN embeddings ON vec_id = doc_id WHERE rank <= 100 GROUP BY ALL)
SELECT query_id, source AS doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM c"""


def label_sources(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("label-"), F.col("label")).alias("source"))


@query(SWEEP)
def collapse_to_sources(spark, sf_dir):
    return judgements.collapse_to_sources(dense_run(spark, sf_dir), label_sources(spark, sf_dir))


def written_pairs(spark, sf_dir):
    """Judgements of vectors divisible by 100: the next three vectors are gold, the three after them partial, each pair
    is asked twice, and the generating vector has grade 2, or 1 where its id is divisible by 300 and its label is even."""
    q = vectors(spark, sf_dir).where("doc_id % 100 = 0").select(F.col("doc_id").alias("pair_id"), "label")
    near = lambda first, last: F.array(*[F.col("pair_id") + i for i in range(first, last)])
    base = q.select(
        "pair_id", near(0, 4).alias("full"), near(4, 7).alias("partial"), near(0, 9).alias("judged"),
        F.when((F.col("pair_id") % 300 == 0) & (F.col("label") % 2 == 0), 1).otherwise(2).alias("grade"),
    )
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), (F.col("pair_id") * 2 + i).alias("query_id")) for i, v in enumerate(judgements.VARIANTS)]))
    return base.withColumn("_v", variants).select("*", "_v.variant", "_v.query_id").drop("_v")


PAIRS = """
q AS (SELECT vec_id AS pair_id, CASE WHEN vec_id % 300 = 0 AND label % 2 = 0 THEN 1 ELSE 2 END AS grade FROM embeddings WHERE vec_id % 100 = 0)"""


@query("WITH " + PAIRS + """,
s AS (SELECT vec_id, 'block-' || vec_id // 3 AS source FROM embeddings)
SELECT q.pair_id * 2 + v AS query_id, q.pair_id, 'block-' || q.pair_id // 3 AS origin_source,
  list_sort(list_distinct(list_transform(range(q.pair_id + CASE WHEN grade = 2 THEN 0 ELSE 1 END, q.pair_id + 4), lambda x: 'block-' || x // 3))) AS confirmed_sources,
  list_sort(list_filter(list_distinct(list_transform(range(q.pair_id + 4, q.pair_id + 7), lambda x: 'block-' || x // 3)),
    lambda y: NOT list_contains(list_transform(range(q.pair_id + CASE WHEN grade = 2 THEN 0 ELSE 1 END, q.pair_id + 4), lambda x: 'block-' || x // 3), y))) AS partial_sources,
  list_sort(list_distinct(list_transform(range(q.pair_id, q.pair_id + 9), lambda x: 'block-' || x // 3))) AS judged_sources
FROM q, range(0, 2) r(v)""")
def source_qrels(spark, sf_dir):
    sources = vectors(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("block-"), F.floor(F.col("doc_id") / 3)).alias("source"))
    out = judgements.source_qrels(written_pairs(spark, sf_dir), sources)
    return out.select("query_id", "pair_id", "origin_source", "confirmed_sources", "partial_sources", "judged_sources")


@query("WITH " + PAIRS + """
SELECT CAST(sum(9) AS BIGINT) AS pool_total, 9 AS pool_min, 9.0::DOUBLE AS pool_mean, 9 AS pool_max,
  CAST(sum(9 - 3 - 3 - 1) AS BIGINT) AS grade_0, CAST(sum(3 + CASE WHEN grade = 1 THEN 1 ELSE 0 END) AS BIGINT) AS grade_1,
  CAST(sum(4 - CASE WHEN grade <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS grade_2, 4 AS arity_min, 4.0::DOUBLE AS arity_mean, 4 AS arity_max,
  count(*) FILTER (grade = 0) AS generating_0, count(*) FILTER (grade = 1) AS generating_1, count(*) FILTER (grade = 2) AS generating_2,
  count(*) FILTER (grade < 2) AS promotions, CAST(sum(3) AS BIGINT) AS batches FROM q""")
def pair_aggregates(spark, sf_dir):
    return judgements.pair_aggregates(written_pairs(spark, sf_dir).where("variant = 'direct'"), 4)


RUNS = "WITH " + DENSE + "," + PREFIX + """,
runs AS (SELECT 'dense' AS system, query_id, rank, doc_id FROM dense WHERE rank <= 100 UNION ALL SELECT 'prefix', query_id, rank, doc_id FROM prefix WHERE rank <= 100)"""


@query(RUNS + """,
l AS (SELECT system, query_id, count(*) AS n FROM runs GROUP BY ALL)
SELECT system, min(n) AS min, max(n) AS max, count(*) FILTER (n >= 1) AS returned_1, count(*) FILTER (n >= 10) AS returned_10 FROM l GROUP BY 1""")
def run_depths(spark, sf_dir):
    asked = vectors(spark, sf_dir).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"))
    return judgements.run_depths(staged_runs(spark, sf_dir), asked)


#: The fixture of judged_coverage: a judged vector has the query's label and a number at most so far from the query's.
JUDGED_IDS = 150
JUDGED = QRELS.replace("q.vec_id <> c.vec_id", f"q.vec_id <> c.vec_id AND abs(c.vec_id - q.vec_id) <= {JUDGED_IDS}")


@query(RUNS + JUDGED + """,
u AS (SELECT r.system, r.query_id, count(*) AS n, count(*) FILTER (q.doc_id IS NULL AND rank <= 1) AS u1, count(*) FILTER (q.doc_id IS NULL) AS uk
  FROM runs r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id WHERE rank <= 10 GROUP BY ALL)
SELECT system, count(*) AS queries, count(*) FILTER (u1 = 0) AS all_1, count(*) FILTER (uk = 0) AS all_k, count(*) FILTER (u1 = 0 AND n >= 1) AS full_1,
  count(*) FILTER (uk = 0 AND n >= 10) AS full_k, round(count(*) FILTER (u1 = 0) / count(*), 6) AS all_1_rate, round(count(*) FILTER (uk = 0) / count(*), 6) AS all_k_rate
FROM u GROUP BY 1""")
def judged_coverage(spark, sf_dir):
    asked = vectors(spark, sf_dir).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"))
    runs = staged_runs(spark, sf_dir)
    judged = labelled(spark, sf_dir, runs).where(f"label = query_label and abs(doc_id - query_id) <= {JUDGED_IDS}").select("query_id", "doc_id")
    out = judgements.coverage(runs, judged, asked)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_rate") else F.col(c) for c in out.columns])


@query(RUNS + """,
p AS (SELECT system, query_id // 200 * 200 AS pair, doc_id, min(rank) AS best FROM runs WHERE rank <= 5 GROUP BY ALL),
s AS (SELECT system, pair, doc_id, row_number() OVER (PARTITION BY system, pair ORDER BY best, doc_id) AS rank FROM p),
a AS (SELECT pair, doc_id, rank, system FROM s WHERE rank <= 11 UNION ALL SELECT DISTINCT query_id // 200 * 200, query_id // 200 * 200, 12, NULL FROM runs),
g AS (SELECT pair AS query_id, doc_id, min(rank) AS best_rank, coalesce(list_sort(list(DISTINCT system) FILTER (system IS NOT NULL)), []) AS systems FROM a GROUP BY ALL)
SELECT query_id, doc_id, CAST(best_rank AS INTEGER) AS best_rank, systems, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc_id) AS INTEGER) AS position FROM g""")
def paired_pools(spark, sf_dir):
    """Vectors 200 n and 200 n + 100 ask as a pair."""
    asked = vectors(spark, sf_dir).where("doc_id % 100 = 0")
    pairs = asked.select(F.col("doc_id").alias("query_id"), (F.floor(F.col("doc_id") / 200) * 200).alias("chunk_id"))
    return judgements.paired_pools(two_runs(spark, sf_dir), pairs, 5)


@query(RUNS + """,
f AS (SELECT query_id, doc_id, min(rank * 2 + CASE system WHEN 'dense' THEN 0 ELSE 1 END) AS place FROM runs GROUP BY ALL)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS position FROM f""")
def interleave(spark, sf_dir):
    runs = two_runs(spark, sf_dir)
    return judgements.interleave(runs.select("query_id", (F.col("system") == "prefix").cast("int").alias("run"), "rank", "doc_id"))


@query("""
WITH e AS (SELECT unnest(list_transform(range(1, len(embedding) + 1), lambda i: {'dim': i - 1, 'x': CAST(embedding[i] AS DOUBLE)})) AS p FROM embeddings),
v AS (SELECT p.dim AS dim, var_pop(p.x) AS var FROM e GROUP BY 1), t AS (SELECT count(*) // 8 AS width, avg(var) AS overall FROM v)
SELECT CAST(dim // width AS BIGINT) AS band, CAST(min(dim) AS INTEGER) AS first, CAST(max(dim) AS INTEGER) AS last, round(avg(var), 6) AS variance, round(avg(var) / max(overall), 6) AS ratio
FROM v, t WHERE dim // width < 8 GROUP BY 1""")
def dimension_variance(spark, sf_dir):
    out = judgements.dimension_variance(vectors(spark, sf_dir))
    return out.select("band", "first", "last", F.round("variance", 6).alias("variance"), F.round("ratio", 6).alias("ratio"))


@query("""WITH q AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark)
SELECT i AS request, item_id AS query_id FROM range(0, 1000) r(i) JOIN q ON pos = (i + 7) % n""")
def query_schedule(spark, sf_dir):
    return judgements.query_schedule(numbered(benchmark(spark, sf_dir), ["query_id"], "pos"), 1000, 7)


@query("""SELECT 'lang' AS field, lang AS value, count(*) AS count FROM documents GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL""")
def theme_counts(spark, sf_dir):
    return judgements.counts_by(table(spark, sf_dir, "documents"), ["lang", "source"])


PHRASES = ("the answer", "license")


@query("""SELECT conv_id, turn, CASE WHEN coalesce(length(text), 0) = 0 THEN 'invalid:empty question' WHEN length(text) < 8 THEN 'invalid:question shorter than 8 characters'
  WHEN length(text) > 60 THEN 'invalid:question longer than 60 characters' WHEN contains(text, 'the answer') THEN 'invalid:self-reference ''the answer'''
  WHEN contains(text, 'license') THEN 'invalid:self-reference ''license''' END AS fault FROM conversations WHERE role = 'user'""")
def question_faults(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", judgements.question_fault(F.col("text"), PHRASES).alias("fault"))
