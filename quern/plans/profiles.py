"""Registered queries: order statistics, shared weights, spans, cover checks and the run machine over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quern.functions import text as T
from quern.operators import chunking, cover, order, stats
from quern.streaming import machine, spans

from .registry import query
from .retrieval import documents, table

TOKENS = """CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, CAST(round_even(
  (length(text) - length(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]', '', 'g'))) / 1.57
  + length(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]', '', 'g')) / 4.49, 0) AS BIGINT)) END"""


@query(f"""WITH t AS (SELECT lang, {TOKENS} AS tokens FROM documents),
l AS (SELECT lang, count(*) AS n, list_sort(list(tokens)) AS v, max(tokens) AS max, count(*) FILTER (tokens < 100) AS under_100 FROM t GROUP BY 1)
SELECT lang, n, v[least(CAST(floor(n * 0.1) AS BIGINT), n - 1) + 1] AS p10, v[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS p50,
  v[least(CAST(floor(n * 0.9) AS BIGINT), n - 1) + 1] AS p90, max, round(under_100 / n, 8) AS under_100 FROM l""")
def corpus_profile(spark, sf_dir):
    """Token sizes of the documents of each language: nearest-index percentiles, the largest, the share under 100."""
    rows = table(spark, sf_dir, "documents").select("lang", T.estimate_tokens(F.col("text")).cast("long").alias("value"))
    p = order.nearest_percentiles(rows, ["lang"], [0.1, 0.5, 0.9])
    rest = rows.groupBy("lang").agg(F.max("value").alias("max"), F.count_if(F.col("value") < 100).alias("small"))
    return p.join(rest, "lang").select(
        "lang", "n", *[F.col("values")[i].alias(c) for i, c in enumerate(("p10", "p50", "p90"))], "max", F.round(F.col("small") / F.col("n"), 8).alias("under_100")
    )


@query()
def chunk_profile(spark, sf_dir):
    """What chunking the documents at 400 tokens with a trigger of 600 comes to. A paragraph is never cut, so a document
    of one long paragraph is one chunk of any size: ``largest_input`` tells it, and no limit fails the report."""
    return chunking.chunk_profile(chunking.chunk_documents(documents(spark, sf_dir).withColumnRenamed("doc_id", "key")), 600, None)


@query("""WITH c AS (SELECT user_id AS cluster, count(*) AS n, sum(CAST(value AS DECIMAL(18, 10))) AS v,
  sum(CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS DECIMAL(18, 10))) AS e, sum(CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DECIMAL(18, 10))) AS p FROM events GROUP BY 1),
l AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS place, count(*) OVER () AS k FROM c),
d AS (SELECT r, CAST('0x' || substr(sha256('7:' || r || ':' || i), 1, 12) AS BIGINT) % k AS place FROM range(0, 100) x(r), (SELECT count(*) AS k FROM c), LATERAL (SELECT unnest(range(0, k)) AS i)),
s AS (SELECT r, CAST(sum(v) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS v, CAST(sum(e) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS e, CAST(sum(p) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS p FROM d JOIN l USING (place) GROUP BY 1),
w AS (SELECT CAST(sum(v) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS v, CAST(sum(e) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS e, CAST(sum(p) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS p, count(*) AS k FROM c),
m AS (SELECT 'value' AS name, v AS m FROM s UNION ALL SELECT 'error', e FROM s UNION ALL SELECT 'purchase', p FROM s UNION ALL SELECT 'error-purchase', e - p FROM s),
q AS (SELECT name, list_sort(list(m)) AS m FROM m GROUP BY 1),
o AS (SELECT 'value' AS name, v AS mean, k FROM w UNION ALL SELECT 'error', e, k FROM w UNION ALL SELECT 'purchase', p, k FROM w UNION ALL SELECT 'error-purchase', e - p, k FROM w)
SELECT name, round(mean, 8) AS mean, round(m[3], 8) AS low, round(m[98], 8) AS high, k AS n FROM o JOIN q USING (name)""")
def shared_bootstrap(spark, sf_dir):
    """Users are clusters of events; mean value and shares of errors and purchases under one set of weights."""
    flag = lambda kind: (F.col("event_type") == kind).cast("int").alias(kind)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("cluster"), "value", flag("error"), flag("purchase"))
    out = stats.shared_bootstrap(rows, ["value", "error", "purchase"], [("error", "purchase")], 100, "7")
    return out.select("name", *[F.round(c, 8).alias(c) for c in ("mean", "low", "high")], "n")


@query("""WITH e AS (SELECT user_id AS t, event_id AS id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000000 AS e FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s, e DESC, id) AS n FROM e),
p AS (SELECT x.t, x.id, arg_max(y.id, y.n) AS parent FROM o x JOIN o y ON y.t = x.t AND y.n < x.n AND y.e >= x.e GROUP BY ALL),
k AS (SELECT p.t, p.parent AS id, greatest(c.s, f.s) AS s, least(c.e, f.e) AS e FROM p JOIN e c ON c.t = p.t AND c.id = p.id JOIN e f ON f.t = p.t AND f.id = p.parent),
r AS (SELECT *, greatest(s, coalesce(max(e) OVER (PARTITION BY t, id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS reach FROM k),
b AS (SELECT t, id, count(*) AS children, CAST(sum(greatest(e - reach, 0)) AS BIGINT) AS busy FROM r GROUP BY ALL)
SELECT e.t AS trace_id, e.id AS span_id, coalesce(parent, -1) AS parent_id, e.e - e.s AS duration, coalesce(children, 0) AS children, e.e - e.s - coalesce(busy, 0) AS own
FROM e LEFT JOIN p ON p.t = e.t AND p.id = e.id LEFT JOIN b ON b.t = e.t AND b.id = e.id""")
def event_spans(spark, sf_dir):
    """A user's events as spans of value * 1000 seconds: the span each lies in, and its own time, in microseconds."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), start.alias("start"),
        (start + F.round(F.col("value") * 1000).cast("long") * 1_000_000).alias("end"),
    )
    tree = spans.nested(rows)
    return tree.select("trace_id", "span_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id")).join(spans.own_time(tree), ["trace_id", "span_id"])


@query("""WITH u AS (SELECT DISTINCT doc_id AS k FROM documents), s AS (
  SELECT 'labels' AS input, doc_id AS k, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT 'vectors', vec_id, count(*) FROM embeddings GROUP BY ALL
  UNION ALL SELECT 'turns', conv_id, count(*) FROM conversations GROUP BY ALL)
SELECT k AS doc_id, input, CASE WHEN s.n IS NULL THEN 'missing' WHEN u2.k IS NULL THEN 'extra' ELSE 'repeated' END AS fault, coalesce(s.n, 0) AS times
FROM (SELECT u.k, i.input FROM u, (SELECT unnest(['labels', 'vectors', 'turns']) AS input) i UNION SELECT k, input FROM s) a
LEFT JOIN s USING (k, input) LEFT JOIN u u2 USING (k) WHERE s.n IS NULL OR u2.k IS NULL OR s.n > 1""")
def cover_faults(spark, sf_dir):
    """Which documents have no label, no vector or no conversation of their number, or several, and what has no document."""
    of = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("doc_id"))
    inputs = {"labels": of("labels", "doc_id"), "vectors": of("embeddings", "vec_id"), "turns": of("conversations", "conv_id")}
    return cover.cover_faults(of("documents", "doc_id"), inputs, "doc_id")


@query("""WITH t AS (SELECT user_id AS task, event_type AS method, count(*) AS times FROM events GROUP BY ALL),
k AS (SELECT DISTINCT user_id AS task FROM events), m AS (SELECT unnest(['view', 'click', 'purchase', 'refund']) AS method)
SELECT task, method, CASE WHEN times IS NULL THEN 'missing' ELSE 'repeated' END AS fault, coalesce(times, 0) AS times FROM (SELECT task, method FROM k, m) a LEFT JOIN t USING (task, method) WHERE times IS NULL OR times > 1
UNION ALL SELECT task, method, 'unknown_method', times FROM t WHERE method NOT IN (SELECT method FROM m)""")
def product_faults(spark, sf_dir):
    """Users by the kinds of events that each should have once."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("method"))
    return cover.product_faults(rows, rows.select("task"), ["view", "click", "purchase", "refund"])


@query()
def run_fold(spark, sf_dir):
    """A user's events as messages of a run, four seconds apart: signups claim it, views are heartbeats of the last claim."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(w).cast("long"))
    kind = F.when(F.col("seq") == 1, "submit").otherwise(F.element_at(
        F.create_map(*[F.lit(x) for x in ("signup", "claim", "view", "heartbeat", "click", "begin", "purchase", "complete", "error", "resume")]), F.col("event_type")
    ))
    claims = F.sum((F.col("kind") == "claim").cast("long")).over(Window.partitionBy("user_id").orderBy("seq"))
    ref = F.concat(F.lit("r"), F.when(F.col("kind") == "resume", F.col("seq")).otherwise(F.col("event_id") % 3).cast("string"))
    made = rows.withColumn("kind", kind).select(
        F.col("user_id").cast("string").alias("run_id"), "seq", "kind", F.lit("w").alias("owner"), claims.alias("epoch"), ref.alias("ref"),
        F.timestamp_millis(F.col("seq") * 4000).alias("at"),
    )
    return machine.fold_runs(made)
