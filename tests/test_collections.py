import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import answering, chunking, generation, ingest
from quern.sources import files
from quern.sources.store import ParquetStore
from quern.streaming import runlog

DOC = "---\ntitle: T\nsummary: s\n---\n# A {#a}\n\nintro [x](y.md) ![i](p.png) {{{ .starter }}}\n\n## B\n\nbody\n\n```\n# no heading\n\ncode\n```\n"


def test_chunks_keep_headings_and_fences():
    chunks = chunking.chunk_text(DOC)
    assert len(chunks) == 1 and chunks[0]["heading_path"] == ["A"]
    assert "intro x i starter" in chunks[0]["text"] and "# no heading" in chunks[0]["text"] and "B\n\nbody" in chunks[0]["text"]
    assert chunks[0]["metadata"] == {"title": "T", "summary": "s"}
    long = "# H\n\n" + "\n\n".join("word " * 200 for _ in range(6))
    parts = chunking.chunk_text(long, 300, 400)
    assert len(parts) > 1 and all(p["heading_path"] == ["H"] for p in parts)
    table = "# T\n\n" + "| a | b |\n" * 900
    only = chunking.chunk_text(table, 100, 200)
    assert len(only) == 1 and chunking.exceedance_reason(only[0]["text"], 200) == "protected_table"
    assert chunking.chunk_text("") == [] and chunking.sections("### deep\nx")[0][0] == ("deep",)
    with pytest.raises(ValueError):
        chunking.chunk_text("x", 10, 5)


def test_chunks_of_fences_tables_and_branches():
    # sections are merged while they fit, and keep the headings that they do not share
    text = "# A\n\none\n\n## B\n\ntwo\n\n## C {#c}\n\nthree\n"
    (only,) = chunking.chunk_text(text)
    assert only["heading_path"] == ["A"] and only["text"] == "one\n\nB\n\ntwo\n\nC\n\nthree"
    # neither headings nor blank lines within a fence cut it, and it counts little while chunks are filled
    fence = "```sql\n# not a heading\n\n" + "select 1;\n" * 400 + "```"
    (one,) = chunking.chunk_text(f"# A\n\nbefore\n\n{fence}\n\nafter", 50, 60)
    assert one["text"] == f"before\n\n{fence}\n\nafter" and chunking.exceedance_reason(one["text"], 60) == "protected_fence"
    table = "| a | b |\n|---|---|\n" + "| word word | word |\n" * 200
    (two,) = chunking.chunk_text(f"# A\n\n{table}\n{fence}", 50, 60)
    assert chunking.exceedance_reason(two["text"], 60) == "protected_fence_and_table" and "| word word | word |" in two["text"]
    # an open fence is text; a single row is no table
    assert len(chunking.chunk_text("# A\n\n```\nopen\n\n# B\n\nx")) == 1 and chunking.sections("# A\n```\n# B\nx")[-1] == (("B",), "x")
    assert chunking.exceedance_reason("| a | " + "word " * 500 + "|", 100) == "indivisible_paragraph"
    # a large section is split at paragraphs and shares no chunk; a paragraph over the target stands alone
    words = "word " * 100
    parts = chunking.chunk_text(f"# A\n\nsmall\n\n# B\n\n{words}\n\n{words}\n\n{words * 5}\n\ntail\n\n# C\n\nend", 300, 400)
    assert [p["heading_path"] for p in parts] == [["A"], ["B"], ["B"], ["B"], ["C"]] and parts[3]["text"] == "tail"
    assert parts[1]["text"].count("\n\n") == 1 and [p["ordinal"] for p in parts] == [0, 1, 2, 3, 4]
    assert chunking.front_matter("---\nnot closed") == ({}, "---\nnot closed") and chunking.front_matter("---\n---\nx") == ({}, "x")
    assert chunking.clean_markup("[![alt](i.png)](u) {{{ .x }}}") == "alt x" and chunking.clean_markup("[a](b) {{{.x}}}", False) == "[a](b) x"


def test_plan_and_delta(rows):
    content = DOC.encode()
    sha = hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()
    line = ("a.md", sha, len(content), "core", "t", "c", "u")
    schema = "path string, blob_sha1 string, size long, collection string, theme string, category string, source_url string"
    manifest = rows(schema, [line, ("b.md", sha, len(content), "temporal_releases", "t", "c", "u")])
    store = rows("key string, content binary", [("core/a.md", content)])
    docs, chunks = ingest.plan_documents(manifest, store, ingest.scope_selects())
    assert docs.count() == 1 and len(chunks.first()["chunk_id"]) == 64
    for bad in ([line, line], [(*line[:1], "zz", *line[2:])]):
        with pytest.raises(PySparkException):
            ingest.checked_manifest(rows(schema, bad)).collect()
    with pytest.raises(PySparkException):
        ingest.plan_documents(manifest, rows("key string, content binary", [("core/a.md", b"x")]), ingest.scope_selects())[0].collect()
    s = "key string, document_sha256 string, metadata_fingerprint string"
    got = ingest.document_delta(
        rows(s, [("new", "1", "m"), ("same", "1", "m"), ("text", "2", "m"), ("meta", "1", "n")]),
        rows(s, [("same", "1", "m"), ("text", "1", "m"), ("meta", "1", "m"), ("gone", "1", "m"), ("out", "1", "m")]),
        rows("key string", [("new",), ("same",), ("text",), ("meta",), ("out",)]),
    )
    assert {r["key"]: r["delta"] for r in got.collect()} == {
        "new": "added", "same": "unchanged", "text": "updated", "meta": "metadata_only", "gone": "deleted", "out": "out_of_scope"
    }
    assert ingest.delta_counts(got).first()["deleted"] == 1


def test_generation(rows):
    df = rows("sample_id int, candidate array<string>, reference array<string>", [(1, list("abcde"), list("abcde")), (2, list("abxde"), list("abcde")), (3, [], ["a"])])
    bleu = {r[0]: r[1] for r in df.select("sample_id", generation.bleu4(F.col("candidate"), F.col("reference"))).collect()}
    assert abs(bleu[1] - 1) < 1e-12 and bleu[2] == 0 and bleu[3] == 0
    rouge = {r["sample_id"]: r["f1"] for r in generation.rouge_l(df).collect()}
    assert rouge[1] == 1 and abs(rouge[2] - 0.8) < 1e-12 and rouge[3] == 0
    assert [generation.sentinel_class(x) for x in ("无法推断", " “无法推断。” ", "我无法推断它", "ok", None)] == ["exact", "normalized", "near", "none", "none"]
    with pytest.raises(PySparkException):
        generation.generation_report(rows("x double", [(1.0,), (None,)]), ["x"]).collect()


def test_strict_replies(rows):
    ok = '{"answerable": true, "blocks": [{"text": "x", "citations": [1]}]}'
    cases = {
        ok: None, '{"answerable": false, "blocks": []}': None, "x": "json_syntax", '{"a": 1, "a": 2}': "json_duplicate_key", '{"a": NaN}': "json_nonfinite",
        "[]": "answer_object", '{"answerable": true}': "answer_missing_field", '{"answerable": 1, "blocks": []}': "answerable_type",
        '{"answerable": true, "blocks": []}': "block_count", ok.replace("[1]", "[2]"): "citation_unread", ok.replace("[1]", "[true]"): "citation_type",
        ok.replace("[1]", "[1, 1]"): "citation_duplicate", ok.replace('"x"', '"see [1]"'): "inline_citation",
    }
    df = rows("reply_id int, raw string, read array<int>", [(i, raw, [1]) for i, raw in enumerate(cases)])
    got = {r["reply_id"]: r["reason"] for r in answering.parse_answers(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert set(filter(None, got.values())) <= set(answering.REASONS)
    assert answering.parse_judgements('```json\n{"judgements": [{"id": 1, "grade": 2}]}\n```', ["d"]) == {"d": 2}


def test_evidence_skips_what_does_not_fit():
    passages = [{"doc_id": 1, "text": "a"}, {"doc_id": 2, "text": "x" * 50_000}, {"doc_id": 1, "text": "a"}, {"doc_id": 3, "text": "b"}]
    got = answering.select_evidence("q", passages)
    assert got["doc_ids"] == [1, 3] and got["skipped"] == 1 and not got["exhausted"]


def test_agent_stays_within_budget():
    replies = iter(['{"action": "search", "query": "q"}', '{"action": "read", "candidate": 1}', '{"action": "answer", "answerable": true, "blocks": [{"text": "t", "citations": [1]}]}'])
    found = [{"doc_id": "d", "title": "t", "text": "text"}]
    got = answering.Investigation(lambda _: next(replies), lambda _: found).run("q")
    assert got["status"] == "answered" and got["read"] == ["d"] and got["searches"] == 1
    loop = answering.Investigation(lambda _: '{"action": "search", "query": "q"}', lambda _: found, answering.Budget(searches=2)).run("q")
    assert loop["status"] == "budget_exhausted" and loop["searches"] == 2
    assert answering.Investigation(lambda _: '{"action": "rm"}', lambda _: found).run("q")["status"] == "invalid_action"


def test_store_lifecycle(spark, rows, tmp_path):
    s = ParquetStore(spark, str(tmp_path))
    s.ensure("c1", 2)
    row = lambda i, v: (i, f"text {i}", v, {1: 0.5}, "k", "0" * 64, 0, {})
    from quern.sources.store import RECORD

    assert s.upsert("c1", rows(RECORD, [row("a", [1.0, 0.0]), row("b", [0.0, 1.0])])) == 2
    s.upsert("c1", rows(RECORD, [row("b", [1.0, 1.0])]))
    assert s.count("c1") == 2
    s.activate_alias("live", "c1")
    assert [r["doc_id"] for r in s.fetch("live", ["b", "zz", "a"]).collect()] == ["b", "a"]
    hits = s.search_dense("live", rows("query_id int, v array<float>", [(1, [1.0, 0.0])]), 1).collect()
    assert hits[0]["doc_id"] == "a"
    assert s.search_sparse("live", rows("query_id int, term int", [(1, 1)]), 5).count() == 2
    for bad in ([row("x", [1.0])], [row("x", [1.0, 0.0])] * 2):
        with pytest.raises((PySparkException, ValueError)):
            s.upsert("c1", rows(RECORD, bad))
    with pytest.raises(ValueError):
        s.upsert("live", rows(RECORD, [row("x", [1.0, 0.0])]))
    s.delete("c1", ["a"])
    assert s.count("live") == 1


def test_caches(rows, tmp_path):
    cache = rows("doc_id string, v array<float>, write_seq int", [("a", [1.0], 1), ("a", [2.0], 2), ("b", [3.0], 1)])
    want = rows("pos int, doc_id string", [(0, "b"), (1, "a")])
    got = files.embedding_matrix(cache, want, 1).orderBy("pos").collect()
    assert [r["v"][0] for r in got] == [3.0, 2.0]
    with pytest.raises(PySparkException):
        files.embedding_matrix(cache, want, 2).collect()
    with pytest.raises(PySparkException):
        files.strict_cache(cache, ["doc_id"], want.select("doc_id")).collect()
    side = tmp_path / "p.json"
    files.provenance({"model": "m"}, str(side))
    with pytest.raises(ValueError):
        files.provenance({"model": "n"}, str(side))
    with files.exclusive_lock(str(tmp_path / "l")):
        with pytest.raises(FileExistsError):
            with files.exclusive_lock(str(tmp_path / "l")):
                pass
    for name in ("a", "b"):
        (tmp_path / name).write_text("old")
    (tmp_path / "a.new").write_text("new")
    with pytest.raises(FileNotFoundError):
        files.publish({str(tmp_path / "a"): str(tmp_path / "a.new"), str(tmp_path / "b"): str(tmp_path / "missing")}, str(tmp_path / "b"))
    assert (tmp_path / "a").read_text() == (tmp_path / "b").read_text() == "old"


def test_run_log(spark, rows, tmp_path):
    log = rows(runlog.EVENT, [("r", 1, "state", '{"status": "queued"}')])
    more = runlog.append_events(log, rows("run_id string, pos int, kind string, payload string", [("r", 1, "state", '{"status": "running"}'), ("s", 1, "x", "{}")]))
    every = log.unionByName(more)
    assert {(r["run_id"], r["seq"]) for r in every.collect()} == {("r", 1), ("r", 2), ("s", 1)}
    assert runlog.fold_status(every).first()["status"] == "running"
    assert [r["seq"] for r in runlog.read_after(every, "r", 1).collect()] == [2]
    with pytest.raises(PySparkException):
        runlog.cursor_pages(every.where("seq <> 1")).collect()
    leases = rows("run_id string, owner string, epoch int, lease_until double", [("r", "me", 2, 10.0)])
    results = rows("run_id string, owner string, epoch int, at double", [("r", "me", 2, 5.0), ("r", "me", 1, 5.0), ("r", "me", 2, 11.0), ("q", "me", 2, 1.0)])
    assert [r["accepted"] for r in runlog.fence(results, leases).orderBy("run_id", "epoch", "at").collect()] == [False, False, True, False]
    runs = rows("run_id string, status string, owner string, epoch int, lease_until double, charged_at double, active_seconds double", [("r", "running", "o", 1, 5.0, 3.0, 1.0), ("k", "running", "o", 1, 50.0, 3.0, 1.0)])
    after = {r["run_id"]: r for r in runlog.recover(runs, rows("run_id string, status string", [("r", "started")]), 9.0).collect()}
    assert (after["r"]["status"], after["r"]["owner"], after["r"]["epoch"], after["r"]["active_seconds"]) == ("unrecoverable", None, 2, 3.0)
    assert after["k"]["status"] == "running" and after["k"]["owner"] == "o"
    commands = rows("run_id string, request_id string, pos int, payload string", [("r", "1", 1, "a"), ("r", "1", 2, "a")])
    assert runlog.idempotent_commands(commands).count() == 1
    with pytest.raises(PySparkException):
        runlog.idempotent_commands(commands.withColumn("payload", F.col("pos").cast("string"))).collect()


def test_log_stream_resumes_from_its_cursor(spark, rows, tmp_path):
    source, target, point = (str(tmp_path / x) for x in ("log", "out", "cursor"))

    def drain():
        q = runlog.stream_runlog(spark, source).writeStream.foreachBatch(runlog.commit_once(target)).option("checkpointLocation", point).trigger(availableNow=True).start()
        q.awaitTermination()

    rows(runlog.EVENT, [("r", 1, "k", "{}")]).coalesce(1).write.mode("append").parquet(source)
    drain()
    rows(runlog.EVENT, [("r", 2, "k", "{}")]).coalesce(1).write.mode("append").parquet(source)
    drain()
    assert sorted(r["seq"] for r in spark.read.parquet(target).collect()) == [1, 2]


def test_registry_imports_without_the_training_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    names = entry.queries()
    assert "hybrid_search" in names and not [n for n in names if n.startswith("op")] and set(entry.oracle_sql()) <= set(names)
