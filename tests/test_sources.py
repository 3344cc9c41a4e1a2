"""Lines and documents from files, and results that survive a failing client."""

import hashlib
import json
import os

import pytest

from quern.sources import documents, resume


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [json.dumps({"id": i, "t": "x" * (i % 50)}) for i in range(4000)]
    lines[2500] = '{"id": 2500, "t": '
    lines[10] = "[1]"
    lines[11] = ""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.jsonl").write_text('{"id": 7, "t": "again"}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        numbers = documents.numbered_lines(spark, str(tmp_path / "in"))
        got = sorted((os.path.basename(r["file"]), r["line"], r["value"]) for r in numbers.collect())
        assert got == sorted([("a.jsonl", i, x) for i, x in enumerate(lines, 1)] + [("b.jsonl", 1, '{"id": 7, "t": "again"}')])
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 3
        rows = documents.jsonl_rows(spark, str(tmp_path / "in"), "id long, t string")
        assert sorted((r["line"], r["fault"]) for r in rows.where("fault is not null").collect()) == [(11, "json"), (2501, "json")] and rows.count() == 4000
        with pytest.raises(ValueError, match="a.jsonl:11: json; a.jsonl:2501: json"):
            documents.read_jsonl_strict(spark, str(tmp_path / "in"), "id long, t string")
        lines[10], lines[2500] = '{"id": 90000}', '{"t": "no key"}'
        (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
        with pytest.raises(ValueError, match="a.jsonl:2501: no id; b.jsonl:1: repeated id"):
            documents.read_jsonl_strict(spark, str(tmp_path / "in"), "id long, t string", "id")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_documents_by_manifest(spark, rows, tmp_path):
    contents = {"core/a.md": b"# A\r\ntext \xff", "core/sub/b.md": b"", "other/c.md": "中".encode()}
    for name, data in contents.items():
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_bytes(data)
    blob = lambda data: hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()
    schema = "path string, blob_sha1 string, size long, collection string, theme string, category string, source_url string"
    listed = [(n.split("/", 1)[1], blob(d), len(d), n.split("/", 1)[0], "t", "c", "u") for n, d in contents.items()]
    files = documents.read_files(spark, str(tmp_path / "docs"), "*.md")
    got = {r["key"]: bytes(r["content"]) for r in documents.load_documents(rows(schema, listed), files).collect()}
    assert got == contents
    wrong = [(*listed[0][:1], "0" * 40, *listed[0][2:]), (*listed[1][:2], 5, *listed[1][3:]), ("gone.md", "1" * 40, 1, "core", "t", "c", "u")]
    faults = {r["key"]: r["fault"] for r in documents.manifest_faults(rows(schema, wrong), files).collect()}
    assert faults == {"core/a.md": "hash", "core/sub/b.md": "missing", "core/gone.md": "missing", "other/c.md": "unlisted"}
    with pytest.raises(ValueError, match="core/a.md: hash"):
        documents.load_documents(rows(schema, wrong), files)
    assert documents.load_documents(rows(schema, listed[:1]), files, unlisted=True).count() == 1


def test_a_failing_client_is_not_asked_twice(rows, tmp_path):
    log = str(tmp_path / "asked")
    path = str(tmp_path / "cache")

    def client(broken):
        def call(values):
            with open(log, "a") as f:
                f.write("".join(f"{v}\n" for v in values))
            if any(v % 10 in broken for v in values):
                raise ValueError("cannot answer")
            return [v * 2.0 for v in values]

        return call

    items = rows("key string, value int", [(f"k{i}", i) for i in range(100)])
    with pytest.raises(RuntimeError, match="20 of 100 items"):
        resume.complete(items, path, client({3, 7}), "double", batch=1)
    first = open(log).read().split()
    out = {r["key"]: r["result"] for r in resume.complete(items, path, client(()), "double", batch=4).collect()}
    asked = open(log).read().split()
    assert out == {f"k{i}": 2.0 * i for i in range(100)} and len(first) == 100 and sorted(asked[100:]) == sorted(x for x in first if x[-1] in "37")
    more = items.union(rows("key string, value int", [("k200", 200)]))
    assert resume.complete(more, path, client(()), "double").count() == 101 and len(open(log).read().split()) == 121
    with pytest.raises(Exception, match="different"):
        resume.complete(items.union(items), str(tmp_path / "other"), client(()), "double")


def test_retries():
    calls = []

    def call(values):
        calls.append(values)
        if len(calls) < 3:
            raise resume.Transient("busy")
        return values

    assert resume.with_retries(call, [1], 3, 0.001) == ([1], None) and len(calls) == 3
    calls.clear()
    assert resume.with_retries(call, [1], 2, 0.001) == (None, "transient: busy") and len(calls) == 2
    assert resume.with_retries(lambda v: [], [1], 5, 0.001)[1] == "0 results for 1 items"
    assert resume.with_retries(lambda v: 1 / 0, [1], 5, 0.001)[1].startswith("ZeroDivisionError")
