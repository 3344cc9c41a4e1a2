"""The run machine: its rules, the fold against a plain loop, and a stream stopped and restarted against the fold."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from quern.streaming import machine, runlog

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def ms(second):
    return int(START.timestamp() * 1000) + int(second * 1000)


def messages(run_id, *rows):
    """(kind, owner, epoch, ref, second) numbered from 1."""
    return [(run_id, i, k, o, e, r, START + timedelta(seconds=s)) for i, (k, o, e, r, s) in enumerate(rows, 1)]


def states(out):
    return [(r["kind"], r["accepted"], r["reason"], r["status"], r["lease_epoch"]) for r in out]


def fold(rows, data, now=None):
    out = machine.fold_runs(rows(machine.MESSAGE, data), now).collect()
    return sorted(out, key=lambda r: (r["run_id"], r["at_ms"], r["seq"] is not None, r["seq"] or 0))


def test_a_run_to_its_end(rows):
    out = fold(rows, messages(
        "a", ("heartbeat", "w", 1, None, 0), ("submit", None, None, None, 0), ("submit", None, None, None, 1), ("claim", "w", None, None, 2),
        ("claim", "x", None, None, 3), ("begin", "w", 1, "t1", 4), ("begin", "w", 1, "t1", 5), ("complete", "x", 1, "t1", 5),
        ("complete", "w", 1, "t1", 6), ("complete", "w", 1, "t1", 7), ("heartbeat", "w", 1, None, 10), ("save", "w", 1, "", 12),
        ("save", "w", 1, "completed", 20), ("heartbeat", "w", 1, None, 21), ("cancel", None, None, "c1", 22),
    ))
    assert [(r["kind"], r["reason"]) for r in out] == [
        ("heartbeat", "unknown_run"), ("submit", ""), ("submit", "exists"), ("claim", ""), ("claim", "not_claimable"), ("begin", ""),
        ("begin", "repeated"), ("complete", "lease_lost"), ("complete", ""), ("complete", "unknown_attempt"), ("heartbeat", ""), ("save", ""),
        ("save", ""), ("heartbeat", "lease_lost"), ("cancel", "run_is_terminal"),
    ]
    assert out[-1]["status"] == "completed" and out[-1]["revision"] == 2 and out[-1]["active_ms"] == 18_000


def test_leases_end_and_fence_their_owners(rows):
    out = fold(rows, messages(
        "a", ("submit", None, None, None, 0), ("claim", "w", None, None, 1), ("heartbeat", "w", 1, None, 30), ("resume", None, None, "r1", 31),
        ("claim", "x", None, None, 32), ("begin", "x", 3, "t", 33), ("complete", "x", 3, "t", 60), ("resume", None, None, "r2", 61),
    ))
    assert states(out) == [
        ("submit", True, "", "queued", 0), ("claim", True, "", "running", 1), ("expired", True, "", "interrupted", 2),
        ("heartbeat", False, "lease_lost", "interrupted", 2), ("resume", True, "", "resuming", 2), ("claim", True, "", "running", 3), ("begin", True, "", "running", 3),
        ("expired", True, "", "unrecoverable", 4), ("complete", False, "lease_lost", "unrecoverable", 4),
        ("resume", False, "run_is_terminal", "unrecoverable", 4),
    ]
    assert [r["at_ms"] for r in out if r["kind"] == "expired"] == [ms(16), ms(47)] and out[-1]["active_ms"] == 30_000


def test_commands_take_effect_at_boundaries_and_once(rows):
    out = fold(rows, messages(
        "a", ("submit", None, None, None, 0), ("pause", None, None, "p1", 1), ("pause", None, None, "p1", 2), ("cancel", None, None, "p1", 3),
        ("resume", None, None, "r1", 4), ("claim", "w", None, None, 5), ("pause", None, None, "p2", 6), ("begin", "w", 1, "t", 7),
        ("cancel", None, None, "c1", 8), ("save", "w", 1, "completed", 9),
    ))
    assert [(r["reason"], r["status"]) for r in out] == [
        ("", "queued"), ("", "paused"), ("repeated", "paused"), ("idempotency_conflict", "paused"), ("", "resuming"), ("", "running"),
        ("", "pausing"), ("stopping", "pausing"), ("", "cancelling"), ("", "cancelled"),
    ]


def random_runs(seed, runs, each):
    rng, out = random.Random(seed), []
    for k in range(runs):
        second, rows = rng.randrange(20), [("submit", None, None, None, 0)]
        for _ in range(each):
            second += rng.choice([0.5, 1, 2, 4, 9, 30])
            kind = rng.choice(["claim", "claim", "heartbeat", "heartbeat", "begin", "complete", "save", "pause", "resume", "resume", "cancel"] if rng.random() < 0.9 else ["submit"])
            ref = {"begin": f"t{rng.randrange(3)}", "complete": f"t{rng.randrange(3)}", "save": rng.choice(["", "", "waiting_input"])}.get(kind, f"q{rng.randrange(60)}")
            if kind == "cancel" and rng.random() < 0.8:
                kind = "heartbeat"
            rows.append((kind, rng.choice("wx"), rng.randrange(1, 6), ref, second))
        out += messages(f"r{k}", *rows)
    return out


def test_fold_ignores_order_and_repeats(rows):
    data = random_runs(1, 6, 40)
    mixed = data + data[::3]
    random.Random(2).shuffle(mixed)
    want = []
    for run_id in sorted({m[0] for m in data}):
        state, requests = machine.fresh(), machine.Requests()
        for m in sorted(x for x in data if x[0] == run_id):
            want += [(run_id, *e) for e in machine.advance(state, requests, *m[1:6], round(m[6].timestamp() * 1000))]
        want += [(run_id, *e) for e in machine.expire(state, ms(10_000))]
    got = machine.fold_runs(rows(machine.MESSAGE, mixed).repartition(5), ms(10_000)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and any(w[2] == "expired" for w in want)
    assert machine.fold_runs(rows(machine.MESSAGE, [])).count() == 0


def test_a_stream_stopped_and_restarted_equals_the_fold(spark, rows, tmp_path):
    source, target, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    data = random_runs(3, 5, 24)
    by_time = sorted(data, key=lambda m: m[6])
    parts = [by_time[i : i + 30] for i in range(0, len(by_time), 30)]
    for a, b in zip(parts, parts[1:]):  # neighbours across a cut change places, and some messages come again
        a[-1], b[0] = b[0], a[-1]
        b.append(a[0])
    end = ("zz", 1, "submit", None, None, None, START + timedelta(seconds=5000))  # moves the watermark past all leases
    parts.append([end])

    def feed(part):
        random.Random(4).shuffle(part)
        rows(machine.MESSAGE, part).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = machine.run_stream(spark.readStream.schema(machine.MESSAGE).option("maxFilesPerTrigger", 1).parquet(source), "10 minutes")
        query = stream.writeStream.foreachBatch(runlog.commit_once(target)).option("checkpointLocation", point).trigger(availableNow=True).start()
        query.awaitTermination(300)

    half = len(parts) // 2
    for part in parts[:half]:
        feed(part)
    run()
    for part in parts[half:]:
        feed(part)
    run()
    got = sorted((tuple(r) for r in spark.read.parquet(target).select(*machine._NAMES).collect()), key=repr)
    want = sorted(map(tuple, machine.fold_runs(rows(machine.MESSAGE, [*data, end]), ms(5000 - 600)).collect()), key=repr)
    assert got == want


def test_a_message_that_never_comes_is_passed_over(spark, rows, tmp_path):
    source, target, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    data = messages("a", ("submit", None, None, None, 0), ("claim", "w", None, None, 1), ("heartbeat", "w", 1, None, 2), ("save", "w", 1, "completed", 3))
    end = ("zz", 1, "submit", None, None, None, START + timedelta(seconds=500))
    late = ("a", 3, "heartbeat", "w", 1, None, START + timedelta(seconds=2))
    for part in ([data[3], data[0]], [data[1]], [end], [late, ("zz", 2, "claim", "w", None, None, START + timedelta(seconds=501))]):
        rows(machine.MESSAGE, part).coalesce(1).write.mode("append").parquet(source)
        stream = machine.run_stream(spark.readStream.schema(machine.MESSAGE).parquet(source), "1 minute")
        stream.writeStream.foreachBatch(runlog.commit_once(target)).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination(300)
    got = [r for r in spark.read.parquet(target).collect() if r["run_id"] == "a"]
    assert sorted(r["seq"] for r in got) == [1, 2, 4] and max(got, key=lambda r: r["seq"])["status"] == "completed"
