"""Durable run log: ordered events, cursors, lease fencing, command idempotency, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

EVENT = "run_id string, seq long, kind string, payload string"
PAGE = 256


def with_timestamp(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant; the session's time zone is UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def append_events(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh(run_id, pos, kind, payload)`` numbered after the highest seq of each run, in order of pos."""
    last = log.groupBy("run_id").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("run_id").orderBy("pos")
    return fresh.join(last, "run_id", "left").select(
        "run_id", (F.coalesce("last", F.lit(0)) + F.row_number().over(w)).cast("long").alias("seq"), "kind", "payload"
    )


def read_after(log: DataFrame, run_id: str, after: int, limit: int = PAGE) -> DataFrame:
    return log.where((F.col("run_id") == run_id) & (F.col("seq") > after)).orderBy("seq").limit(limit)


def cursor_pages(log: DataFrame, page: int = PAGE) -> DataFrame:
    """Adds the page of a cursor that reads ``page`` events at a time, and fails on a gap in a run's numbers."""
    w = Window.partitionBy("run_id").orderBy("seq")
    checked = log.withColumn("_at", F.row_number().over(w)).where(
        F.when(F.col("_at") == F.col("seq"), F.lit(True)).otherwise(F.raise_error(F.lit("gap in the event log")).cast("boolean"))
    )
    return checked.withColumn("page", F.floor((F.col("_at") - 1) / page)).drop("_at")


def fold_status(log: DataFrame) -> DataFrame:
    """(run_id, status, seq): the last state event of each run."""
    states = log.where("kind = 'state'")
    return states.groupBy("run_id").agg(F.max(F.struct("seq", F.get_json_object("payload", "$.status").alias("status"))).alias("s")).select("run_id", "s.status", "s.seq")


def fence(results: DataFrame, leases: DataFrame) -> DataFrame:
    """Splits ``results(run_id, owner, epoch, at, ...)`` by ``leases(run_id, owner, epoch, lease_until)``: accepted is
    true only for the current owner and epoch before the lease ends."""
    now = leases.select("run_id", F.col("owner").alias("_o"), F.col("epoch").alias("_e"), "lease_until")
    ok = (F.col("owner") == F.col("_o")) & (F.col("epoch") == F.col("_e")) & (F.col("at") < F.col("lease_until"))
    return results.join(now, "run_id", "left").withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_o", "_e", "lease_until")


def recover(runs: DataFrame, attempts: DataFrame, now: float) -> DataFrame:
    """State of ``runs(run_id, status, owner, epoch, lease_until, charged_at, active_seconds)`` after expired leases.

    A started call of unknown outcome is never repeated: its run becomes unrecoverable. Time is charged up to the end
    of the lease and never negative; the epoch moves on, so that the former owner's results are refused.
    """
    open_ = attempts.where("status = 'started'").select("run_id").distinct().withColumn("_u", F.lit(True))
    gone = F.col("owner").isNotNull() & (F.col("lease_until") <= now)
    status = (
        F.when(F.col("status") == "cancelling", "cancelled").when(F.col("_u"), "unrecoverable")
        .when(F.col("status") == "pausing", "paused").otherwise("interrupted")
    )
    spent = F.greatest(F.lit(0.0), F.least(F.lit(now), F.col("lease_until")) - F.col("charged_at"))
    after = runs.join(open_, "run_id", "left").withColumn("_gone", F.coalesce(gone, F.lit(False)))
    pick = lambda a, b: F.when(F.col("_gone"), a).otherwise(F.col(b)).alias(b)
    return after.select(
        "run_id", pick(status, "status"), pick(F.lit(None).cast("string"), "owner"), pick(F.col("epoch") + 1, "epoch"),
        pick(F.lit(None).cast("double"), "lease_until"), pick(F.lit(now), "charged_at"), pick(F.col("active_seconds") + spent, "active_seconds"),
    )


def idempotent_commands(commands: DataFrame) -> DataFrame:
    """The first of each ``(run_id, request_id)``; the same request with another payload fails the job."""
    w = Window.partitionBy("run_id", "request_id").orderBy("pos")
    first = commands.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.first("payload").over(w))
    same = F.when(F.col("payload").eqNullSafe(F.col("_p")), F.lit(True)).otherwise(F.raise_error(F.lit("idempotency conflict")).cast("boolean"))
    return first.where(same).where("_n = 1").drop("_n", "_p")


def pair_events(log: DataFrame) -> DataFrame:
    """(run_id, invocation_id, started, completed, ordinal) from start and complete events of ``log(run_id, seq, kind,
    action, invocation_id)``; ordinal counts an action's invocations within its run."""
    pairs = log.groupBy("run_id", "action", "invocation_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("seq"))).alias("started"),
        F.max(F.when(F.col("kind") == "complete", F.col("seq"))).alias("completed"),
    )
    w = Window.partitionBy("run_id", "action").orderBy("started", "invocation_id")
    return pairs.withColumn("ordinal", F.row_number().over(w))


def stream_runlog(spark: SparkSession, path: str):
    """The log as a stream; its checkpoint is the cursor."""
    return spark.readStream.schema(EVENT).parquet(path)


def commit_once(target: str):
    """A foreachBatch sink that rewrites a batch's own folder, so that a repeated batch leaves one copy."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return sink


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = with_timestamp(events)
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return with_timestamp(events).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("events")).select(
        F.col("window.start").alias("window_start"), "event_type", "events"
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return with_timestamp(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select(
        "user_id", F.col("session_window.start").alias("session_start"), "events"
    )


def latency_report(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Linear percentiles per key; no task holds a key's samples."""
    from quern.operators.order import linear_percentiles

    p = linear_percentiles(samples.select(key, F.col(value).alias("value")), [key], [0.5, 0.95, 0.99])
    return p.select(key, F.col("n").alias("samples"), *[F.col("values")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


def benchmark_report(samples: DataFrame, wall_seconds: float) -> DataFrame:
    """Throughput, error rate and latency of the successful ``samples(status, elapsed)``."""
    from quern.operators.order import linear_percentiles

    ok = F.col("status") == 200
    c = samples.agg(F.count("*").alias("requests"), F.count_if(ok).alias("succeeded"), F.lit(1).alias("_all"))
    fine = samples.where(ok).select(F.lit(1).alias("_all"), F.col("elapsed").alias("value"))
    p = linear_percentiles(fine, ["_all"], [0.5, 0.95, 0.99]).select("_all", "values")
    return c.join(F.broadcast(p), "_all", "left").select(  # one row
        "requests", "succeeded", (F.col("succeeded") / F.lit(wall_seconds)).alias("qps"),
        F.expr("try_divide(requests - succeeded, requests)").alias("error_rate"),
        *[F.col("values")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))],
    )


CLAIMABLE = ("queued", "resuming")


def claim(runs: DataFrame, claims: DataFrame, now: float, lease: float) -> DataFrame:
    """``runs(run_id, status, owner, epoch, lease_until, charged_at, profile, snapshot)`` after ``claims(run_id, owner,
    profile, snapshot)``, at most one a run; expired leases are recovered before.

    A free run that waits goes to its claimant under the next epoch. A claim under another profile or snapshot makes it
    unrecoverable; a run that is held or does not wait stays as it is.
    """
    asked = claims.select("run_id", F.col("owner").alias("_o"), F.col("profile").alias("_p"), F.col("snapshot").alias("_s"))
    rows = runs.join(asked, "run_id", "left")
    free = F.col("_o").isNotNull() & F.col("status").isin(*CLAIMABLE) & F.col("owner").isNull()
    same = F.col("profile").eqNullSafe(F.col("_p")) & F.col("snapshot").eqNullSafe(F.col("_s"))
    took = rows.withColumn("_free", F.coalesce(free, F.lit(False))).withColumn("_took", F.col("_free") & same)
    pick = lambda value, name: F.when(F.col("_took"), value).otherwise(F.col(name)).alias(name)
    status = F.when(F.col("_took"), "running").when(F.col("_free"), "unrecoverable").otherwise(F.col("status"))
    return took.select(
        "run_id", status.alias("status"), pick(F.col("_o"), "owner"), pick(F.col("epoch") + 1, "epoch"),
        pick(F.lit(now + lease), "lease_until"), pick(F.lit(now), "charged_at"), "profile", "snapshot",
    )


def heartbeat(runs: DataFrame, beats: DataFrame, now: float, lease: float) -> DataFrame:
    """``runs(run_id, status, owner, epoch, lease_until, charged_at, active_seconds)`` after ``beats(run_id, owner,
    epoch)``, at most one a run: time since the last charge is added, never negative, and the lease is prolonged. The
    job fails on a beat of anyone but the current owner and epoch before the lease ends."""
    from quern.operators.ingest import require

    rows = runs.join(beats.select("run_id", F.col("owner").alias("_o"), F.col("epoch").alias("_e")), "run_id", "left")
    mine = (F.col("owner") == F.col("_o")) & (F.col("epoch") == F.col("_e")) & (F.col("lease_until") > now)
    rows = require(rows, F.col("_o").isNull() | F.coalesce(mine, F.lit(False)), "the lease is lost")
    beat = F.col("_o").isNotNull()
    spent = F.greatest(F.lit(0.0), F.lit(now) - F.col("charged_at"))
    pick = lambda value, name: F.when(beat, value).otherwise(F.col(name)).alias(name)
    return rows.select(
        "run_id", "status", "owner", "epoch", pick(F.lit(now + lease), "lease_until"), pick(F.lit(now), "charged_at"),
        pick(F.col("active_seconds") + spent, "active_seconds"),
    )
