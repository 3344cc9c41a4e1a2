"""Registered queries: leases, commands and invocations of runs, complete pairs, overlaps, and quotes found in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import judgements, pooling, quotes
from quern.sources import files
from quern.streaming import runlog

from .registry import query
from .retrieval import table

RUNS = """r AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id, ['queued', 'running', 'resuming', 'paused'][c_custkey % 4 + 1] AS status,
  CASE WHEN c_custkey % 4 = 1 THEN 'w' || c_nationkey END AS owner, c_nationkey AS epoch, CASE WHEN c_custkey % 4 = 1 THEN 1000.0 + c_custkey % 50 END AS lease_until,
  CASE WHEN c_custkey % 4 = 1 THEN 990.0 END AS charged_at, c_mktsegment AS profile, 's' || c_custkey % 3 AS snapshot FROM customer)"""


def runs(spark, sf_dir):
    """Customers as runs: every fourth is held by the worker of its nation until a time of its own."""
    key = F.col("c_custkey")
    held = key % 4 == 1
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("run_id"), F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "resuming", "paused")]), (key % 4 + 1).cast("int")).alias("status"),
        F.when(held, F.concat(F.lit("w"), "c_nationkey")).alias("owner"), F.col("c_nationkey").alias("epoch"),
        F.when(held, 1000.0 + key % 50).alias("lease_until"), F.when(held, F.lit(990.0)).alias("charged_at"),
        F.col("c_mktsegment").alias("profile"), F.concat(F.lit("s"), key % 3).alias("snapshot"), key.alias("key"),
    )


@query("WITH " + RUNS + """, a AS (SELECT *, CAST(run_id AS BIGINT) % 5 = 0 AS asked, CAST(run_id AS BIGINT) % 7 <> 0 AS same FROM r),
t AS (SELECT *, asked AND status IN ('queued', 'resuming') AND owner IS NULL AS free FROM a)
SELECT run_id, CASE WHEN free AND same THEN 'running' WHEN free THEN 'unrecoverable' ELSE status END AS status, CASE WHEN free AND same THEN 'new' ELSE owner END AS owner,
  CASE WHEN free AND same THEN epoch + 1 ELSE epoch END AS epoch, CASE WHEN free AND same THEN 1035.0 ELSE lease_until END AS lease_until FROM t""")
def run_claims(spark, sf_dir):
    """Every fifth run is claimed, every seventh of those under another snapshot."""
    rows = runs(spark, sf_dir)
    other = F.when(F.col("key") % 7 == 0, F.lit("other")).otherwise(F.col("snapshot"))
    claims = rows.where("key % 5 = 0").select("run_id", F.lit("new").alias("owner"), "profile", other.alias("snapshot"))
    return runlog.claim(rows, claims, 1020.0, 15.0).select("run_id", "status", "owner", "epoch", "lease_until")


@query("WITH " + RUNS + """, b AS (SELECT *, owner IS NOT NULL AND lease_until > 1020.0 AS beat FROM r)
SELECT run_id, CASE WHEN beat THEN 1035.0 ELSE lease_until END AS lease_until, CASE WHEN beat THEN 1020.0 ELSE charged_at END AS charged_at,
  CASE WHEN beat THEN 1.5 + 30.0 ELSE 1.5 END AS active_seconds FROM b""")
def run_heartbeats(spark, sf_dir):
    """All runs whose lease holds are beaten by their owners."""
    rows = runs(spark, sf_dir).withColumn("active_seconds", F.lit(1.5))
    beats = rows.where("owner is not null and lease_until > 1020.0").select("run_id", "owner", "epoch")
    return runlog.heartbeat(rows, beats, 1020.0, 15.0).select("run_id", "lease_until", "charged_at", "active_seconds")


@query("WITH " + RUNS + """, q AS (SELECT *, CASE WHEN CAST(run_id AS BIGINT) % 3 = 0 THEN 'x' ELSE owner END AS sender FROM r)
SELECT run_id, coalesce(sender = owner AND 1020.0 < lease_until, false) AS accepted FROM q WHERE sender IS NOT NULL""")
def run_fence(spark, sf_dir):
    """Results of owners and, for every third run, of another worker."""
    rows = runs(spark, sf_dir)
    by = F.when(F.col("key") % 3 == 0, F.lit("x")).otherwise(F.col("owner"))
    results = rows.select("run_id", by.alias("owner"), "epoch", F.lit(1020.0).alias("at")).where("owner is not null")
    return runlog.fence(results, rows.select("run_id", "owner", "epoch", "lease_until")).select("run_id", "accepted")


@query("SELECT user_id AS run_id, event_type AS request_id, event_id AS pos FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def command_requests(spark, sf_dir):
    """The first request of each kind of a user."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("request_id"), F.col("event_id").alias("pos"), F.lit("p").alias("payload"))
    return runlog.idempotent_commands(rows).select("run_id", "request_id", "pos")


@query("""WITH l AS (SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'complete' END AS kind, event_type AS action, event_id // 6 AS invocation_id FROM events),
p AS (SELECT run_id, action, invocation_id, min(seq) FILTER (kind = 'start') AS started, max(seq) FILTER (kind = 'complete') AS completed FROM l GROUP BY ALL)
SELECT run_id, action, invocation_id, coalesce(started, -1) AS started, coalesce(completed, -1) AS completed,
  CAST(row_number() OVER (PARTITION BY run_id, action ORDER BY started NULLS FIRST, invocation_id) AS INTEGER) AS ordinal FROM p""")
def invocations(spark, sf_dir):
    """Starts and ends of invocations among a user's events."""
    kind = F.when(F.col("event_id") % 3 == 0, "start").otherwise("complete")
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("action"), F.floor(F.col("event_id") / 6).alias("invocation_id")
    )
    out = runlog.pair_events(log)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("started", "completed")})


@query("""SELECT conv_id AS chunk_id, turn, role AS variant FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT role) = 2)""")
def complete_pairs(spark, sf_dir):
    """Turns of the conversations with exactly two roles."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chunk_id"), "turn", F.col("role").alias("variant"))
    return pooling.complete_pairs(rows)


@query("""WITH o AS (SELECT lang AS variant, doc_id AS id, round(n_chars / 7.0, 4) AS overlap FROM documents),
l AS (SELECT variant, count(*) AS n, round(CAST(sum(CAST(overlap AS DECIMAL(18, 10))) AS DOUBLE) / count(*), 4) AS mean, list_sort(list(overlap)) AS v FROM o GROUP BY 1)
SELECT variant, n, mean, v[least(CAST(floor(n * 0.1) AS BIGINT), n - 1) + 1] AS p10, v[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS p50,
  v[least(CAST(floor(n * 0.9) AS BIGINT), n - 1) + 1] AS p90 FROM l""")
def overlap_summary(spark, sf_dir):
    """A value of each document summed up by language."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("variant"), F.col("doc_id").alias("id"), F.round(F.col("n_chars") / 7.0, 4).alias("overlap"))
    return judgements.overlap_summary(rows)


@query("SELECT vec_id AS doc_id, len(embedding) AS width FROM embeddings")
def strict_cache(spark, sf_dir):
    """Vectors as a cache that must hold exactly the wanted ids."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("width"))
    return files.strict_cache(rows, ["doc_id"], rows.select("doc_id"))


def _plain(column: str) -> str:
    form = column
    for pattern, keep in ((quotes._KEPT[0], "\\1"), (quotes._KEPT[1], ""), (quotes._KEPT[2], ""), (quotes._GONE, "")):
        form = f"regexp_replace({form}, '{pattern}', '{keep}', 'g')"
    return f"replace(lower({form}), 'ß', 'ss')"


@query(f"""WITH q AS (SELECT item_id, {_plain('text')} AS q FROM benchmark WHERE text IS NOT NULL), d AS (SELECT doc_id, {_plain('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT item_id, doc_id, CAST((length(t) - length(replace(t, q, ''))) / length(q) AS BIGINT) AS times FROM q JOIN d ON contains(t, q) WHERE q <> ''""")
def quoted_passages(spark, sf_dir):
    """How often each benchmark text stands in each document, whatever the wrapping and markup."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    found = quotes.quote_places(table(spark, sf_dir, "documents").select("doc_id", "text"), asked)
    return found.groupBy(F.col("quote_id").alias("item_id"), "doc_id").agg(F.count("*").alias("times"))
