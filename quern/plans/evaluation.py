"""Registered queries: inference, samples, pools and text generation metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window, functions as F

from quern.functions import text as T
from quern.operators import generation, lexical, pooling, stats

from .registry import query
from .retrieval import DENSE, GRAMS, PREFIX, TWO, benchmark, dense_run, documents, few, table, two_runs, two_systems

@query("""WITH c AS (SELECT event_type AS family, CAST(isodow(ts) AS VARCHAR) AS name, count(*) AS n, count(*) FILTER (value > 40) AS k FROM events GROUP BY ALL),
p AS (SELECT family, name, round(2 / (1 + exp(1.702 * abs(2 * k - n) / sqrt(n))), 8) AS p FROM c),
s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p) AS step FROM p),
a AS (SELECT *, max(step) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS adjusted FROM s)
SELECT family, name, p, round(adjusted, 8) AS adjusted, bool_and(adjusted <= 0.05) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS reject FROM a""")
def holm(spark, sf_dir):
    """For each kind of event, a family of sign tests by weekday: do as many values lie above 40 as below? The normal tail
    of the two-sided p-values is that of the logistic approximation."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), (F.weekday("ts") + 1).cast("string").alias("name"), (F.col("value") > 40).alias("above"))
    c = rows.groupBy("family", "name").agg(F.count("*").alias("n"), F.count_if("above").alias("k"))
    p = F.round(2 / (1 + F.exp(1.702 * F.abs(2 * F.col("k") - F.col("n")) / F.sqrt("n"))), 8)
    return stats.holm(c.select("family", "name", p.alias("p"))).withColumn("adjusted", F.round("adjusted", 8))


@query(TWO + """, c AS (SELECT count(*) FILTER (b > 0 AND t = 0) AS only_baseline, count(*) FILTER (b = 0 AND t > 0) AS only_treatment FROM u),
f AS (SELECT *, only_baseline + only_treatment AS n FROM c),
k AS (SELECT f.*, CAST(i AS BIGINT) AS i FROM f, range(0, 60) r(i) WHERE i <= n)
SELECT only_baseline, only_treatment, round(least(1.0, 2 * least(
  coalesce(sum(CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE) / factorial(CAST(i AS INTEGER)) / factorial(CAST(n - i AS INTEGER))) FILTER (i >= only_treatment), 0) / pow(2, n),
  coalesce(sum(CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE) / factorial(CAST(i AS INTEGER)) / factorial(CAST(n - i AS INTEGER))) FILTER (i >= only_baseline), 0) / pow(2, n))), 8) AS p_value
FROM k GROUP BY only_baseline, only_treatment, n""")
def mcnemar(spark, sf_dir):
    b, t = two_systems(spark, sf_dir)
    both = b.select("unit_id", F.col("value").alias("b")).join(t.select("unit_id", F.col("value").alias("t")), "unit_id")
    counts = both.agg(F.count_if((F.col("b") > 0) & (F.col("t") == 0)).alias("only_baseline"), F.count_if((F.col("b") == 0) & (F.col("t") > 0)).alias("only_treatment"))

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(stats.mcnemar_exact(int(i), int(j)), 8) for i, j in zip(x, y)])

    return counts.withColumn("p_value", exact("only_baseline", "only_treatment"))


@query()
def permutation(spark, sf_dir):
    """Sign-flip test of the difference of two runs, by label of the query."""
    b, t = two_systems(spark, sf_dir)
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), "label")
    diffs = b.withColumnRenamed("value", "b").join(t.withColumnRenamed("value", "t"), "unit_id").join(label, "unit_id").groupBy("label").agg(F.sum((F.col("t") - F.col("b")).cast("decimal(18,10)")).cast("double").alias("d"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        p, exact = stats.group_permutation(f.sort_values("label")["d"].tolist())
        return pd.DataFrame([{"groups": len(f), "p_value": p, "exact": exact}])

    return diffs.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "groups long, p_value double, exact boolean")  # ten labels


@query()
def bootstrap_ci(spark, sf_dir):
    """Seeded interval of the reciprocal rank, units and clusters (labels)."""
    _, t = two_systems(spark, sf_dir)
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").alias("cluster"))
    rows = t.join(label, "unit_id")
    plain = rows.select(F.lit("units").alias("kind"), "unit_id", F.lit(None).cast("int").alias("cluster"), "value")
    return stats.bootstrap_table(plain.unionByName(rows.select(F.lit("clusters").alias("kind"), "unit_id", "cluster", "value")), ["kind"], resamples=2000)


CLUSTER_SQL = """
c AS (SELECT lang, source, CAST(sum({num}) AS DECIMAL(28, 10)) AS num, CAST(count(*) AS DECIMAL(28, 10)) AS den FROM documents GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS place FROM c),
s AS (SELECT lang, count(*) AS n, sum(num) AS tn, sum(den) AS td FROM p GROUP BY 1),
dr AS (SELECT lang, r, i, n, CAST(('0x' || substr(sha256('0:' || r || ':' || i), 1, 12)) AS BIGINT) % n AS place FROM s, range(0, 200) a(r), range(0, 1000) b(i) WHERE i < n),
m AS (SELECT lang, r, CAST(sum(num) / sum(den) AS DOUBLE) AS m FROM dr JOIN p USING (lang, place) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m, r) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS size FROM m)
SELECT lang, round(CAST(any_value(tn) / any_value(td) AS DOUBLE), 6) AS mean, round(max(m) FILTER (spot = floor(0.025 * size)), 6) AS low,
       round(max(m) FILTER (spot = least(floor(0.975 * size), size - 1)), 6) AS high, any_value(n) AS n FROM o JOIN s USING (lang) GROUP BY 1"""


def by_source(spark, sf_dir, value):
    rows = table(spark, sf_dir, "documents").groupBy("lang", F.col("source").alias("cluster")).agg(F.sum(value).alias("num"), F.count("*").alias("den"))
    out = stats.hash_bootstrap(rows, ["lang"])
    return out.select("lang", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("WITH " + CLUSTER_SQL.format(num="n_chars"))
def cluster_bootstrap(spark, sf_dir):
    return by_source(spark, sf_dir, F.col("n_chars"))


@query("WITH " + CLUSTER_SQL.format(num="CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END"))
def ratio_ci(spark, sf_dir):
    return by_source(spark, sf_dir, (F.col("n_chars") >= 1000).cast("int"))


FRAME = "unhex(lpad(printf('%x', octet_length(encode({x}))), 16, '0')) || encode({x})"


def framed(*fields: str) -> str:
    return "sha256(" + " || ".join(FRAME.format(x=f) for f in fields) + ")"


@query("""WITH c AS (SELECT source, count(*) AS c FROM documents GROUP BY 1),
e AS (SELECT *, 100 * c / (SELECT sum(c) FROM c) AS e, floor(100 * c / (SELECT sum(c) FROM c)) AS q FROM c),
k AS (SELECT source, q + CASE WHEN row_number() OVER (ORDER BY e - q DESC, source) <= 100 - (SELECT sum(q) FROM e) THEN 1 ELSE 0 END AS quota FROM e),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY """ + framed(f"'{pooling.SAMPLE_SCHEMA}'", "'7'", "CAST(doc_id AS VARCHAR)") + """, doc_id) AS n FROM documents)
SELECT doc_id, source FROM r JOIN k USING (source) WHERE n <= quota""")
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pooling.stratified_sample(rows, "source", "doc_id", 100, "7").select("doc_id", "source")


RUNS = "WITH " + DENSE + "," + PREFIX + """,
runs AS (SELECT 'dense' AS system, query_id, rank, doc_id FROM dense WHERE rank <= 20 UNION ALL SELECT 'prefix', query_id, rank, doc_id FROM prefix WHERE rank <= 20),
pool AS (SELECT query_id, doc_id, min(rank) AS best_rank, string_agg(DISTINCT system, ',' ORDER BY system) AS systems FROM runs GROUP BY ALL)"""


def pool(spark, sf_dir):
    return pooling.pool_union(two_runs(spark, sf_dir), 20)


@query(RUNS + " SELECT query_id, doc_id, CAST(best_rank AS INTEGER) AS best_rank, systems, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc_id) AS INTEGER) AS position FROM pool")
def pool_union(spark, sf_dir):
    return pool(spark, sf_dir).withColumn("systems", F.array_join("systems", ","))


@query(RUNS + """ SELECT 'dense' AS name, count(*) AS candidates FROM pool WHERE contains(systems, 'dense') UNION ALL SELECT 'prefix', count(*) FROM pool WHERE contains(systems, 'prefix')
UNION ALL SELECT 'unique_candidates', count(*) FROM pool UNION ALL SELECT 'exclusive_to_one_system', count(*) FROM pool WHERE NOT contains(systems, ',')""")
def pool_contribution(spark, sf_dir):
    return pooling.pool_contribution(pool(spark, sf_dir))


@query(RUNS + """, k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY """ + framed(f"'{pooling.ORDER_SCHEMA}'", "'11'", "CAST(doc_id AS VARCHAR)") + """) AS n FROM pool)
SELECT query_id, doc_id, CAST(n AS INTEGER) AS judging_position, CAST(floor((n - 1) / 10) AS BIGINT) AS batch FROM k""")
def keyed_order(spark, sf_dir):
    return pooling.judging_order(pool(spark, sf_dir), "11").select("query_id", "doc_id", "judging_position", "batch")


@query("""WITH c AS (SELECT n_chars, count(*) AS c FROM documents GROUP BY 1),
m AS (SELECT n_chars, 3 * (2 * coalesce(sum(c) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + c) AS mid, sum(c) OVER () AS n FROM c)
SELECT doc_id, n_chars, CASE WHEN mid <= 2 * n THEN 'low' WHEN mid <= 4 * n THEN 'middle' ELSE 'high' END AS stratum FROM documents JOIN m USING (n_chars)""")
def overlap_tertiles(spark, sf_dir):
    return pooling.overlap_tertiles(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "n_chars", "stratum")


BOTH_GRAMS = "WITH " + GRAMS.format(id="doc_id", table="documents") + "," + GRAMS.format(id="item_id", table="benchmark").replace("d AS", "qd AS").replace("g AS", "qg AS").replace("FROM d ", "FROM qd ")


@query(BOTH_GRAMS + """, q AS (SELECT DISTINCT item_id, term FROM qg), t AS (SELECT DISTINCT doc_id, term FROM g), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1)
SELECT item_id, doc_id, round(count(*) / any_value(n), 8) AS containment FROM q JOIN t USING (term) JOIN n USING (item_id) GROUP BY ALL""")
def bigram_containment(spark, sf_dir):
    """Share of each benchmark text's bigrams in each document that shares one."""
    q = lexical.query_terms(benchmark(spark, sf_dir)).withColumnRenamed("query_id", "item_id")
    n = q.groupBy("item_id").agg(F.count("*").alias("n"))
    t = documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(T.char_ngrams(F.col("text"), 2))).alias("term"))
    out = t.join(few(q), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("c")).join(few(n), "item_id")
    return out.select("item_id", "doc_id", F.round(F.col("c") / F.col("n"), 8).alias("containment"))


USER_KEY = "conv_id * 10000 + turn"


@query("""WITH r AS (SELECT """ + USER_KEY + """ AS id, regexp_replace(text, '\\s', '', 'g') AS s FROM conversations WHERE role = 'user'),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) AS t FROM r WHERE length(s) >= 2),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.id AS earlier, b.id AS later, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT earlier, later, round(c / (x.n + y.n - c), 8) AS similarity FROM o JOIN n x ON x.id = earlier JOIN n y ON y.id = later WHERE c / (x.n + y.n - c) >= 0.5""")
def near_questions(spark, sf_dir):
    """Pairs of user turns with similar bigram sets."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.expr(USER_KEY).alias("id"), "text").where(F.length(F.regexp_replace("text", T.WHITESPACE, "")) >= 2)
    return pooling.near_questions(rows, T.char_ngrams(F.col("text"), 2), "id", 0.5).withColumn("similarity", F.round("similarity", 8))


@query("""WITH RECURSIVE u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, v, regexp_replace(coalesce(text, ''), '\\s', '', 'g') AS s FROM u WHERE v <= 2 AND conv_id IN (SELECT conv_id FROM u WHERE v = 2)),
g AS (SELECT DISTINCT conv_id, v, t FROM (SELECT conv_id, v, unnest(CASE WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substring(s, i, 2)) END) AS t FROM r)),
n AS (SELECT conv_id, v, count(*) AS n FROM g GROUP BY ALL),
o AS (SELECT a.conv_id AS a, a.v AS av, b.conv_id AS b, b.v AS bv, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.conv_id < b.conv_id GROUP BY ALL),
e AS (SELECT DISTINCT a, b FROM o JOIN n x ON x.conv_id = a AND x.v = av JOIN n y ON y.conv_id = b AND y.v = bv WHERE c / (x.n + y.n - c) >= 0.5),
m AS (SELECT d.conv_id AS id, row_number() OVER (ORDER BY d.conv_id) AS i, coalesce(l, []) AS l
      FROM (SELECT DISTINCT conv_id FROM r) d LEFT JOIN (SELECT b, list(a) AS l FROM e GROUP BY 1) x ON x.b = d.conv_id),
k(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT m.i, CASE WHEN list_has_any(kept, l) THEN kept ELSE list_append(kept, id) END FROM k JOIN m ON m.i = k.i + 1),
f AS (SELECT arg_max(kept, i) AS kept FROM k)
SELECT id AS conv_id, list_contains(kept, id) AS kept, coalesce(list_min(list_intersect(l, kept)), -1) AS repeats FROM m, f""")
def deduped_questions(spark, sf_dir):
    """The first two user turns of a conversation are a chunk's questions; a conversation goes if one is like a kept one's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("variant", F.row_number().over(w)).where("variant <= 2")
    both = asked.groupBy("conv_id").agg(F.count("*").alias("n")).where("n = 2").select("conv_id")
    rows = asked.join(both, "conv_id").select(F.col("conv_id").alias("chunk_id"), "variant", "text")
    out = pooling.dedupe_questions(rows, T.char_ngrams(F.col("text"), 2), 0.5)
    return out.select(F.col("chunk_id").alias("conv_id"), "kept", F.coalesce("repeats", F.lit(-1)).alias("repeats"))


PAIRS = """pairs AS (SELECT u.conv_id * 10000 + u.turn AS sample_id, string_split(a.text, ' ') AS c, string_split(u.text, ' ') AS r
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def answer_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    u = rows.where("role = 'user'").select("conv_id", "turn", F.split("text", " ").alias("reference"))
    a = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.split("text", " ").alias("candidate"))
    return u.join(a, ["conv_id", "turn"]).select(F.expr(USER_KEY).alias("sample_id"), "candidate", "reference")


@query("WITH " + PAIRS + """,
k AS (SELECT sample_id, n, list_transform(range(1, greatest(len(c) - n + 2, 1)), lambda i: array_to_string(c[i : i + n - 1], chr(31))) AS cg,
      list_transform(range(1, greatest(len(r) - n + 2, 1)), lambda i: array_to_string(r[i : i + n - 1], chr(31))) AS rg FROM pairs, range(1, 5) t(n)),
cc AS (SELECT sample_id, n, unnest(cg) AS g FROM k), rr AS (SELECT sample_id, n, unnest(rg) AS g FROM k),
ca AS (SELECT sample_id, n, g, count(*) AS x FROM cc GROUP BY ALL), ra AS (SELECT sample_id, n, g, count(*) AS y FROM rr GROUP BY ALL),
o AS (SELECT sample_id, n, sum(least(x, y)) AS o FROM ca JOIN ra USING (sample_id, n, g) GROUP BY ALL),
p AS (SELECT k.sample_id, k.n, CASE WHEN len(cg) = 0 THEN 0.0 ELSE coalesce(o, 0) / len(cg) END AS p FROM k LEFT JOIN o USING (sample_id, n)),
s AS (SELECT sample_id, min(p) AS low, sum(CASE WHEN p > 0 THEN ln(p) ELSE 0 END) AS l FROM p GROUP BY 1)
SELECT sample_id, round(CASE WHEN low = 0 THEN 0.0 ELSE exp(l / 4) * CASE WHEN len(c) >= len(r) THEN 1.0 ELSE exp(1 - len(r) / len(c)) END END, 8) AS bleu4
FROM s JOIN pairs USING (sample_id)""")
def bleu4(spark, sf_dir):
    return answer_pairs(spark, sf_dir).select("sample_id", F.round(generation.bleu4(F.col("candidate"), F.col("reference")), 8).alias("bleu4"))


@query("WITH " + PAIRS + """,
ca AS (SELECT sample_id, t, count(*) AS x FROM (SELECT sample_id, unnest(c) AS t FROM pairs) GROUP BY ALL), ra AS (SELECT sample_id, t, count(*) AS y FROM (SELECT sample_id, unnest(r) AS t FROM pairs) GROUP BY ALL),
o AS (SELECT sample_id, sum(least(x, y)) AS o FROM ca JOIN ra USING (sample_id, t) GROUP BY 1)
SELECT sample_id, round(CAST(coalesce(o, 0) / len(c) AS DOUBLE), 8) AS "precision", round(CAST(coalesce(o, 0) / len(r) AS DOUBLE), 8) AS recall, round(CAST(2 * coalesce(o, 0) / (len(c) + len(r)) AS DOUBLE), 8) AS f1
FROM pairs LEFT JOIN o USING (sample_id)""")
def token_f1(spark, sf_dir):
    pairs = answer_pairs(spark, sf_dir)
    side = lambda c: pairs.select("sample_id", F.explode(c).alias("token"))
    out = generation.token_f1(side("candidate"), side("reference"))
    return out.select("sample_id", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query()
def rouge_l(spark, sf_dir):
    return generation.rouge_l(answer_pairs(spark, sf_dir))


@query("""SELECT CASE WHEN contains(coalesce(text, ''), '""" + generation.SENTINEL + """') THEN 'near' ELSE ['none', 'exact', 'normalized', 'near'][(conv_id + turn) % 4 + 1] END AS sentinel, count(*) AS turns FROM conversations GROUP BY 1""")
def sentinel(spark, sf_dir):
    """Every fourth turn stands as it is; the others are answers that are the sentinel, quote it, or hold it beside their text."""
    said = F.lit(generation.SENTINEL)
    made = F.element_at(F.array(F.col("text"), said, F.concat(F.lit(" \u201c"), said, F.lit("\u201d\u3002 ")), F.concat_ws(" ", F.coalesce("text", F.lit("x")), said)), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("text").contains(generation.SENTINEL), F.concat(F.lit("x "), "text")).otherwise(made).alias("answer"))
    return generation.classify_answers(rows).groupBy("sentinel").agg(F.count("*").alias("turns"))
