import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import ingest
from quern.streaming import runlog


def test_model_names_and_addresses(rows):
    names = rows("a string, b string", [("Qwen/X-8B", "qwen/x-8b"), ("É", "é"), ("", ""), ("a", None), ("a", "a ")])
    assert [r[0] for r in names.select(T.model_names_match(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]
    urls = ["https://a.example/x?y#z", "HTTP://a", "ftp://a", "https://u:p@a/", "https:///x", "https://a b", "https://a\\b", None, "https://a/" + "x" * 4000]
    got = [r[0] for r in rows("i int, u string", list(enumerate(urls))).orderBy("i").select(T.safe_source_url(F.col("u"))).collect()]
    assert got == urls[:2] + [None] * 7


def test_rerank_tokens_count_the_scaffold_once_a_document(rows):
    one = rows("q string, d array<string>", [("ab", ["x" * 9, "y"]), ("ab", [])])
    n = [r[0] for r in one.select(T.rerank_tokens(F.col("q"), F.col("d"), "head", "tail")).collect()]
    assert n == [round((4 + 2 + 9 + 4) / 4.49) + round((4 + 2 + 1 + 4) / 4.49), 0]


RUNS = "run_id string, status string, owner string, epoch long, lease_until double, charged_at double, profile string, snapshot string"


def test_claims_take_free_runs_only(rows):
    runs = rows(RUNS, [
        ("a", "queued", None, 0, None, None, "p", "s"), ("b", "running", "w", 3, 50.0, 1.0, "p", "s"), ("c", "resuming", None, 1, None, None, "p", "old"),
        ("d", "queued", None, 0, None, None, "p", "s"),
    ])
    claims = rows("run_id string, owner string, profile string, snapshot string", [(r, "me", "p", "s") for r in "abc"])
    got = {r["run_id"]: (r["status"], r["owner"], r["epoch"], r["lease_until"]) for r in runlog.claim(runs, claims, 10.0, 30.0).collect()}
    assert got == {"a": ("running", "me", 1, 40.0), "b": ("running", "w", 3, 50.0), "c": ("unrecoverable", None, 1, None), "d": ("queued", None, 0, None)}


def test_heartbeats_charge_and_fence(rows):
    kind = "run_id string, status string, owner string, epoch long, lease_until double, charged_at double, active_seconds double"
    runs = rows(kind, [("a", "running", "me", 2, 20.0, 5.0, 1.0), ("b", "running", "w", 1, 20.0, 5.0, 1.0)])
    beat = lambda *b: runlog.heartbeat(runs, rows("run_id string, owner string, epoch long", [b]), 12.0, 30.0)
    got = {r["run_id"]: (r["lease_until"], r["charged_at"], r["active_seconds"]) for r in beat("a", "me", 2).collect()}
    assert got == {"a": (42.0, 12.0, 8.0), "b": (20.0, 5.0, 1.0)}
    for wrong in (("a", "me", 1), ("b", "me", 1)):
        with pytest.raises(Exception, match="lease is lost"):
            beat(*wrong).collect()


def test_a_partial_plan_stops_the_build(rows):
    manifest = rows("collection string, path string", [("c", "x"), ("c", "y")])
    keys = manifest.select(ingest.source_key(F.col("collection"), F.col("path")).alias("key"))
    assert ingest.every_scoped_planned(manifest, keys, F.lit(True)).count() == 2
    first = keys.limit(1)
    assert ingest.every_scoped_planned(manifest, first, F.lit(False)).count() == 1
    with pytest.raises(Exception, match="not planned"):
        ingest.every_scoped_planned(manifest, first, F.lit(True))
