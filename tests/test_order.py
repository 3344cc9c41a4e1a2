"""Places, order statistics, shared weights, spans and cover checks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, cover, order, pooling, stats
from quern.streaming import spans


def groups(seed):
    rng = random.Random(seed)
    data = [("many", float(rng.randrange(5000)) / 7) for _ in range(900)] + [("ties", 1.5)] * 400 + [("ties", float(i)) for i in range(3)]
    data += [("one", 4.0), (None, 2.0), (None, 3.0), ("nulls", None)]
    return data


@pytest.mark.parametrize("direct", [10_000, 5])
def test_percentiles_at_any_size(rows, monkeypatch, direct):
    monkeypatch.setattr(order, "DIRECT", direct)
    if direct == 5:
        monkeypatch.setattr(order, "SPLITTERS", 8)
    data = groups(1)
    table = rows("g string, value double", data).repartition(4)
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    of = {}
    for g, v in data:
        if v is not None:
            of.setdefault(g, []).append(v)
    near = {r["g"]: (r["n"], r["values"]) for r in order.nearest_percentiles(table, ["g"], qs).collect()}
    assert near == {g: (len(v), [chunking.nearest_index(v, q) for q in qs]) for g, v in of.items()}
    import numpy as np

    line = {r["g"]: r["values"] for r in order.linear_percentiles(table, ["g"], qs).collect()}
    assert line.keys() == of.keys()
    for g, v in of.items():
        assert line[g] == pytest.approx([np.percentile(v, 100 * q) for q in qs], abs=1e-9)


def test_places_and_tertiles(rows, monkeypatch):
    rng = random.Random(2)
    data = [(rng.choice([None, "a", "b"]), rng.randrange(6), "k") for _ in range(300)]
    got = sorted((r["place"], r["x"] or "", r["y"]) for r in order.numbered(rows("x string, y int, _k string", data).repartition(5), ["x", "y"]).collect())
    assert [g[0] for g in got] == list(range(300)) and [g[1:] for g in got] == sorted((x or "", y) for x, y, _ in data)
    monkeypatch.setattr(order, "DIRECT", 3)
    values = [rng.randrange(12) for _ in range(200)]
    out = pooling.overlap_tertiles(rows("id int, v int", list(enumerate(values))), "v").collect()
    n = len(values)
    for r in out:
        mid = 3 * (2 * sum(v < r["v"] for v in values) + values.count(r["v"]))
        assert r["stratum"] == ("low" if mid <= 2 * n else "middle" if mid <= 4 * n else "high")
    assert len(out) == n and pooling.overlap_tertiles(rows("v int", []), "v").count() == 0


def test_columns_share_the_weights(rows):
    data = [(f"c{i % 9}", float(i), float(i) + 2.0) for i in range(40)]
    out = {r["name"]: r for r in stats.shared_bootstrap(rows("cluster string, a double, b double", data), ["a", "b"], [("b", "a")], 200, "s").collect()}
    # under shared weights the difference is the same in every replicate
    assert out["b-a"]["low"] == pytest.approx(2) == out["b-a"]["high"] and out["a"]["low"] < out["a"]["mean"] < out["a"]["high"] and out["a"]["n"] == 9
    with pytest.raises(Exception, match="missing"):
        stats.shared_bootstrap(rows("cluster string, a double", [("x", None)]), ["a"]).collect()


def test_spans(rows):
    data = [("t", 1, 0, 10), ("t", 2, 1, 4), ("t", 3, 3, 8), ("t", 4, 3, 8), ("t", 5, 9, 12), ("t", 6, 20, 20), ("u", 7, 0, 1), (None, 8, 0, 5), (None, 9, 1, 2)]
    table = rows("trace_id string, span_id int, start long, end long", data)
    tree = spans.nested(table)
    got = {r["span_id"]: (r["parent_id"], r["depth"]) for r in tree.collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (1, 1), 4: (3, 2), 5: (None, 0), 6: (None, 0), 7: (None, 0), 8: (None, 0), 9: (8, 1)}
    own = {r["span_id"]: (r["duration"], r["children"], r["own"]) for r in spans.own_time(tree).where("trace_id is not null").collect()}
    assert own == {1: (10, 2, 3), 2: (3, 0, 3), 3: (5, 1, 0), 4: (5, 0, 5), 5: (3, 0, 3), 6: (0, 0, 0), 7: (1, 0, 1)}
    with pytest.raises(Exception, match="before it starts"):
        spans.nested(rows("trace_id string, span_id int, start long, end long", [("t", 1, 5, 4)])).collect()


def test_span_trees_by_parent(rows):
    chain = [("t", i, i - 1 if i else None) for i in range(20)] + [("t", 100, 99), ("t", 101, 100), ("u", 5, None)]
    got = {(r["trace_id"], r["span_id"]): (r["root_id"], r["depth"]) for r in spans.tree(rows("trace_id string, span_id int, parent_id int", chain)).collect()}
    assert got == {("t", i): (0, i) for i in range(20)} | {("t", 100): (100, 0), ("t", 101): (100, 1), ("u", 5): (5, 0)}
    with pytest.raises(ValueError, match="cycle"):
        spans.tree(rows("trace_id string, span_id int, parent_id int", [("t", 1, 2), ("t", 2, 3), ("t", 3, 1)]))


def test_cover_and_strict_join(rows):
    keys = lambda *ks: rows("k string, v int", [(k, i) for i, k in enumerate(ks)])
    universe = rows("k string", [("a",), ("b",), ("c",)])
    faults = cover.cover_faults(universe, {"x": keys("a", "b", "b", "d"), "y": keys("a", "b", "c", None, "")}, "k")
    assert sorted(map(tuple, faults.collect()), key=repr) == sorted(
        [("b", "x", "repeated", 2), ("c", "x", "missing", 0), ("d", "x", "extra", 1), (None, "y", "empty", 1), ("", "y", "empty", 1)], key=repr
    )
    with pytest.raises(ValueError, match="x: missing 'c'"):
        cover.strict_join(universe, {"x": keys("a", "b"), "y": keys("a", "b", "c")}, "k")
    out = cover.strict_join(universe, {"x": keys("a", "b", "c"), "y": keys("c", "b", "a")}, "k")
    assert sorted(map(tuple, out.collect())) == [("a", 0, 2), ("b", 1, 1), ("c", 2, 0)] and out.columns == ["k", "x.v", "y.v"]


def test_product_of_tasks_and_methods(rows):
    trials = rows("task string, method string", [("t1", "m"), ("t1", "n"), ("t2", "m"), ("t2", "m"), ("t9", "m"), ("t1", "zz"), ("t3", None)])
    got = cover.product_faults(trials, rows("task string", [("t1",), ("t2",), ("t3",)]), ["m", "n"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        ("t2", "m", "repeated", 2), ("t2", "n", "missing", 0), ("t3", "m", "missing", 0), ("t3", "n", "missing", 0), ("t9", "m", "unknown_task", 1),
        ("t1", "zz", "unknown_method", 1), ("t3", None, "unknown_method", 1),
    ], key=repr)


def test_chunk_profile(rows):
    fence = "```\n" + "code line here\n" * 400 + "```"
    docs = rows("key string, text string", [("a", "# T\n\n" + "word " * 30), ("b", fence), ("c", None)])
    chunks = chunking.chunk_documents(docs, 400, 600)
    r = chunking.chunk_profile(chunks, 600).first()
    sizes = sorted(x["approx_tokens"] for x in chunks.collect())
    assert (r["documents"], r["chunks"], r["max"], r["total"]) == (2, len(sizes), sizes[-1], sum(sizes))
    assert r["over_trigger"] == r["protected_fence"] == 1 and r["over_rate"] == 1 / len(sizes) and r["p50"] == pytest.approx((sizes[0] + sizes[1]) / 2)
    with pytest.raises(Exception, match="over the limit"):
        chunking.chunk_profile(chunks, 600, 100).collect()


def test_chunk_profile_of_a_paragraph_over_the_limit(spark, tmp_path):
    from quern.plans import registry

    data = [(1, "word " * 40_000), (2, "short"), (3, None)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = registry.queries()["chunk_profile"](spark, str(tmp_path)).first()
    assert (r["documents"], r["chunks"], r["over_trigger"], r["indivisible_paragraph"]) == (2, 2, 1, 1) and r["largest_input"] == r["max"] > 8192
