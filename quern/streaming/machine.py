"""Runs as a state machine over messages: leases with epochs, attempts, commands; folded in a batch or kept as a stream's state.

A run's messages are numbered (``seq`` from 1). The same transitions are applied by ``fold_runs`` to a whole table and by
``run_stream`` to messages as they come, so that a stream that was stopped and restarted gives the rows of the fold.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "run_id string, seq long, kind string, owner string, epoch long, ref string, at timestamp"
EVENT = (
    "run_id string, seq long, kind string, accepted boolean, reason string, status string, owner string, lease_epoch long,"
    " revision long, active_ms long, at_ms long"
)
#: How long a claim or heartbeat holds a run.
LEASE_MS = 15_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The names of states.
TERMINAL = frozenset(["completed", "cancelled", "failed", "budget_exhausted", "unrecoverable"])
WAITING = frozenset(["queued", "resuming"])
PAUSABLE = frozenset(["running", "resuming", "queued", "pausing"])


def fresh() -> dict:
    return {"seq": 0, "status": None, "owner": None, "epoch": 0, "lease": None, "charged": None, "active": 0, "revision": 0, "open": {}}


def event(run: dict, kind: str, at: int, reason: str = "", seq: int | None = None) -> tuple:
    return (seq, kind, reason == "" or reason == "repeated", reason, run["status"], run["owner"], run["epoch"], run["revision"], run["active"], at)


def charge(run: dict, now: int) -> None:
    """Active time runs to the end of the lease at most, and never backwards."""
    run["active"] += max(0, min(now, run["lease"]) - run["charged"])
    run["charged"] = max(run["charged"], min(now, run["lease"]))


def release(run: dict, status: str) -> None:
    run.update(status=status, owner=None, lease=None)


def expire(run: dict, now: int) -> list[tuple]:
    """The event of a lease that has ended: the outcome of an open attempt is unknown, so its run cannot go on."""
    if run["owner"] is None or run["lease"] > now:
        return []
    end = run["lease"]
    charge(run, end)
    stopped = {"cancelling": "cancelled"}.get(run["status"]) or ("unrecoverable" if run["open"] else None)
    release(run, stopped or {"pausing": "paused"}.get(run["status"], "interrupted"))
    run.update(epoch=run["epoch"] + 1, open={})
    return [event(run, "expired", end)]


def command(run: dict, kind: str) -> str:
    if run["status"] in TERMINAL:
        return "run_is_terminal"
    held = run["owner"] is not None
    if kind == "resume" and run["status"] in ("paused", "interrupted", "waiting_input"):
        run["status"] = "resuming"
    elif kind == "pause" and run["status"] in PAUSABLE:
        run["status"] = "pausing" if held else "paused"
    elif kind == "cancel":
        run["status"] = "cancelling" if held else "cancelled"
    else:
        return "invalid_run_state"
    return ""


def owned(run: dict, kind: str, ref: str | None, now: int) -> str:
    """What the holder of the lease may do."""
    charge(run, now)
    if kind == "heartbeat":
        run["lease"] = now + LEASE_MS
    elif kind == "begin":
        if run["status"] in ("pausing", "cancelling"):
            return "stopping"
        if ref in run["open"]:
            return "repeated"
        run["open"][ref] = run["epoch"]
    elif kind in ("complete", "fail"):
        if run["open"].get(ref) != run["epoch"]:
            return "unknown_attempt"
        del run["open"][ref]
    elif kind == "save":
        run["revision"] += 1
        if ref:
            release(run, "cancelled" if run["status"] == "cancelling" else ref)
            run["open"] = {}
    else:
        return "unknown_kind"
    return ""


def advance(run: dict, requests, seq: int, kind: str, owner: str | None, epoch: int | None, ref: str | None, now: int) -> list[tuple]:
    """The events of one message; ``requests`` has ``get(ref)`` and ``put(ref, kind)`` of the run's commands."""
    out = expire(run, now)
    run["seq"] = seq
    if kind == "submit":
        reason = "" if run["status"] is None else "exists"
        run["status"] = run["status"] or "queued"
    elif run["status"] is None:
        reason = "unknown_run"
    elif kind in ("pause", "resume", "cancel"):
        before = requests.get(ref)
        reason = ("repeated" if before == kind else "idempotency_conflict") if before else command(run, kind)
        if not before and not reason:
            requests.put(ref, kind)
    elif kind == "claim":
        free = run["status"] in WAITING and run["owner"] is None
        reason = "" if free else "not_claimable"
        if free:
            run.update(status="running", owner=owner, epoch=run["epoch"] + 1, lease=now + LEASE_MS, charged=now)
    elif run["owner"] is None or (run["owner"], run["epoch"]) != (owner, epoch):
        reason = "lease_lost"
    else:
        reason = owned(run, kind, ref, now)
    return [*out, event(run, kind, now, reason, seq)]


class Requests(dict):
    put = dict.__setitem__


def _given(value):
    return None if value is None or pd.isna(value) else value


def _messages(frame: pd.DataFrame) -> list[tuple]:
    at = frame["at"].astype("int64") // {"ns": 1_000_000, "us": 1_000, "ms": 1}[frame["at"].dt.unit] if len(frame) else []
    return [
        (int(s), k, _given(o), None if _given(e) is None else int(e), _given(r), int(t))
        for s, k, o, e, r, t in zip(frame["seq"], frame["kind"], frame["owner"], frame["epoch"], frame["ref"], at)
    ]


_NAMES = [f.split()[0] for f in EVENT.split(", ")]


def _events(run_id: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(run_id, *r) for r in rows], columns=_NAMES)
    return out.astype({"seq": "Int64"})


def fold_runs(messages: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Rows of EVENT for ``messages`` (rows of MESSAGE): each run's in order of seq, and the leases that ended by ``now_ms``.

    Repeated messages (a seq that was there) have no effect and no row; a missing seq is passed over. A run is folded as its
    rows stream by: a task holds the state of one run and one batch of rows, however long the run.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, requests = None, fresh(), Requests()
        for frame in frames:
            for run_id, part in frame.groupby("run_id", sort=False):
                if run_id != key:
                    if key is not None and now_ms is not None:
                        yield _events(key, expire(state, now_ms))
                    key, state, requests = run_id, fresh(), Requests()
                rows: list[tuple] = []
                for m in _messages(part):
                    if m[0] > state["seq"]:
                        rows += advance(state, requests, *m)
                yield _events(run_id, rows)
        if key is not None and now_ms is not None:
            yield _events(key, expire(state, now_ms))

    dealt = messages.repartition("run_id").sortWithinPartitions("run_id", "seq", "at")
    return dealt.mapInPandas(run, EVENT)


class RunMachine(StatefulProcessor):
    """Value state: the run. List state: messages that came before one with a lower seq. Map state: its commands. A timer
    stands at the end of the lease, and at the earliest waiting message: once the watermark has passed that one, what is
    missing before it is too late to come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "state string")
        self.waiting = handle.getListState("waiting", "seq long, kind string, owner string, epoch long, ref string, at_ms long")
        self.requests = handle.getMapState("requests", "ref string", "kind string")

    def get(self, ref: str | None) -> str | None:
        return self.requests.getValue((ref or "",))[0] if self.requests.containsKey((ref or "",)) else None

    def put(self, ref: str | None, kind: str) -> None:
        self.requests.updateValue((ref or "",), (kind,))

    def _state(self) -> dict:
        return json.loads(self.run.get()[0]) if self.run.exists() else fresh()

    def _apply(self, state: dict, messages: list[tuple], passed: int | None = None) -> list[tuple]:
        """The events of the messages that are next in order; with ``passed`` also of those behind a gap before that time."""
        rows: list[tuple] = []
        left: list[tuple] = []
        for m in sorted(set(messages), key=lambda m: (m[0], m[5])):
            if m[0] <= state["seq"]:
                continue
            if m[0] == state["seq"] + 1 or (passed is not None and m[5] <= passed and not left):
                rows += advance(state, self, *m)
            else:
                left.append(m)
        if left:
            self.waiting.put(left)
        elif self.waiting.exists():
            self.waiting.clear()
        self.run.update((json.dumps(state),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for t in {state["lease"], min((m[5] for m in left), default=None)} - {None}:
            self.handle.registerTimer(t)
        return rows

    def _waiting(self) -> list[tuple]:
        return [tuple(m) for m in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        messages = self._waiting()
        for frame in rows:
            messages += _messages(frame)
        yield _events(key[0], self._apply(self._state(), messages))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state = self._state()
        rows = self._apply(state, self._waiting(), now)
        ended = expire(state, now)
        if ended:
            rows += ended + self._apply(state, self._waiting())
        yield _events(key[0], rows)

    def close(self) -> None:
        pass


def run_stream(messages: DataFrame, late: str = "1 minute") -> DataFrame:
    """Rows of EVENT of a stream of MESSAGE, kept in state until the watermark decides what is late.

    Messages may come in any order and more than once within the watermark's delay; each takes effect once, in order of
    seq. Needs the RocksDB state store (``ROCKSDB``). Written with ``runlog.commit_once`` the output of an epoch that is
    repeated after a failure replaces itself.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        messages.withWatermark("at", late).groupBy("run_id")
        .transformWithStateInPandas(RunMachine(), outputStructType=EVENT, outputMode="Append", timeMode="EventTime")
    )
