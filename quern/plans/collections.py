"""Registered queries: collection deltas, stores, chunking, evidence, run log and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answering, chunking, ingest
from quern.sources import files, store
from quern.streaming import runlog

from .registry import query
from .retrieval import dense_run, documents, table

PREVIOUS = """prev AS (
  SELECT CAST(doc_id AS VARCHAR) AS key, sha256(CASE WHEN source = 'src1' THEN text || '!' ELSE text END) AS s, CASE WHEN source = 'src2' THEN 'old' ELSE source END AS m
  FROM documents WHERE lang <> 'es' UNION ALL SELECT 'gone-' || doc_id, 'x', 'y' FROM documents WHERE lang = 'es'
), plan AS (SELECT CAST(doc_id AS VARCHAR) AS key, sha256(text) AS s, source AS m FROM documents WHERE lang <> 'fr')"""


@query("WITH " + PREVIOUS + """
SELECT coalesce(plan.key, prev.key) AS key, CASE WHEN plan.key IS NULL THEN CASE WHEN l.key IS NOT NULL THEN 'out_of_scope' ELSE 'deleted' END
  WHEN prev.key IS NULL THEN 'added' WHEN plan.s <> prev.s THEN 'updated' WHEN plan.m <> prev.m THEN 'metadata_only' ELSE 'unchanged' END AS delta
FROM plan FULL JOIN prev ON plan.key = prev.key LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS key FROM documents) l ON l.key = coalesce(plan.key, prev.key)""")
def document_delta(spark, sf_dir):
    return states_delta(spark, sf_dir)


@query("WITH " + PREVIOUS + """, d AS (
SELECT CASE WHEN plan.key IS NULL THEN CASE WHEN l.key IS NOT NULL THEN 'out_of_scope' ELSE 'deleted' END
  WHEN prev.key IS NULL THEN 'added' WHEN plan.s <> prev.s THEN 'updated' WHEN plan.m <> prev.m THEN 'metadata_only' ELSE 'unchanged' END AS delta
FROM plan FULL JOIN prev ON plan.key = prev.key LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS key FROM documents) l ON l.key = coalesce(plan.key, prev.key))
SELECT """ + ", ".join(f"count(*) FILTER (delta = '{d}') AS {d}" for d in ingest.DELTAS) + " FROM d")
def delta_counts(spark, sf_dir):
    return ingest.delta_counts(states_delta(spark, sf_dir))


def states_delta(spark, sf_dir):
    """Documents without French against a previous state without Spanish, with some sources changed."""
    rows = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    old_text = F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kept = rows.where("lang <> 'es'").select(key.alias("key"), F.sha2(old_text, 256).alias("document_sha256"), F.when(F.col("source") == "src2", "old").otherwise(F.col("source")).alias("metadata_fingerprint"))
    gone = rows.where("lang = 'es'").select(F.concat(F.lit("gone-"), key).alias("key"), F.lit("x").alias("document_sha256"), F.lit("y").alias("metadata_fingerprint"))
    planned = rows.where("lang <> 'fr'").select(key.alias("key"), F.sha2("text", 256).alias("document_sha256"), F.col("source").alias("metadata_fingerprint"))
    return ingest.document_delta(planned, kept.unionByName(gone), rows.select(key.alias("key")))


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, 'de-new', n_chars + 1 FROM documents WHERE lang = 'de'""")
def upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    fresh = rows.where("lang = 'de'").select("doc_id", F.lit("de-new").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"))
    return store.upsert_rows(rows, fresh, "doc_id")


@query("""SELECT CAST(item_id AS INTEGER) AS pos, d.doc_id, d.n_chars FROM benchmark b JOIN documents d ON d.doc_id = 7 * b.item_id""")
def fetch_ordered(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("pos"), (7 * F.col("item_id")).alias("doc_id"))
    return store.fetch_ordered(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), wanted).select("pos", "doc_id", "n_chars")


@query("""SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || unhex('00') || encode(text)) AS blob_sha1,
sha256(unhex(lpad(printf('%x', octet_length(encode('quern-chunk-v1'))), 16, '0')) || encode('quern-chunk-v1')
 || unhex(lpad(printf('%x', octet_length(encode(source))), 16, '0')) || encode(source) || unhex(lpad('1', 16, '0')) || encode('0')
 || unhex(lpad(printf('%x', octet_length(encode(text))), 16, '0')) || encode(text)) AS chunk_id FROM documents""")
def stable_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", T.git_blob_sha1(F.encode("text", "UTF-8")).alias("blob_sha1"), ingest.chunk_id(F.col("source"), F.lit(0), F.col("text")).alias("chunk_id"))


@query()
def chunk_markdown(spark, sf_dir):
    """Documents have no headings; they are split on blank lines where they are oversized."""
    out = chunking.chunk_documents(documents(spark, sf_dir).withColumnRenamed("doc_id", "key"))
    return out.select("key", "ordinal", "approx_tokens", F.size("heading_path").alias("depth"), F.sha2("text", 256).alias("text_sha256"))


@query()
def pack_evidence(spark, sf_dir):
    run = dense_run(spark, sf_dir, 20)
    rows = run.join(documents(spark, sf_dir), "doc_id").select("query_id", F.lit("question").alias("query"), "rank", "doc_id", F.lit("").alias("title"), "text")
    out = answering.pack_evidence(rows)
    return out.select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"), "skipped", "exhausted")


@query("SELECT conv_id * 10000 + turn AS reply_id, 'invalid_answer' AS status, 'json_syntax' AS reason FROM conversations")
def parse_answers(spark, sf_dir):
    """Prose is no valid reply: every turn is rejected with its reason."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("reply_id"), F.col("text").alias("raw"), F.array(F.lit(1)).alias("read"))
    return answering.parse_answers(rows).select("reply_id", "status", "reason")


@query("""SELECT event_type, count(*) AS samples, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_report(spark, sf_dir):
    out = runlog.latency_report(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "samples", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("""SELECT count(*) AS requests, count(*) FILTER (event_type <> 'error') AS succeeded, round(count(*) FILTER (event_type <> 'error') / 60.0, 6) AS qps,
round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, round(quantile_cont(value, 0.5) FILTER (event_type <> 'error'), 6) AS p50,
round(quantile_cont(value, 0.95) FILTER (event_type <> 'error'), 6) AS p95, round(quantile_cont(value, 0.99) FILTER (event_type <> 'error'), 6) AS p99 FROM events""")
def benchmark_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("elapsed"))
    out = runlog.benchmark_report(rows, 60.0)
    return out.select("requests", "succeeded", *[F.round(c, 6).alias(c) for c in ("qps", "error_rate", "p50", "p95", "p99")])


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def lww_dedupe(spark, sf_dir):
    return files.last_write_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type AS kind,
CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 256) AS BIGINT) AS page FROM events""")
def event_cursor(spark, sf_dir):
    """Events numbered per user and read in pages of a cursor."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    log = runlog.append_events(spark.createDataFrame([], runlog.EVENT), rows)
    return runlog.cursor_pages(log).select("run_id", "seq", "kind", "page")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    out = runlog.tumbling(table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("""SELECT date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS window_start, event_type, count(*) AS events FROM events, range(0, 2) r(k) GROUP BY ALL""")
def event_sliding(spark, sf_dir):
    return runlog.sliding(table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l)
SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return runlog.sessions(table(spark, sf_dir, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))
