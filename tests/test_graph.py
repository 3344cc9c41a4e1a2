"""Components and the greedy independent set against the sequential rule: chains, hubs, cycles, random graphs."""

import random

import pytest

from quern.functions import text as T
from quern.operators import graph, pooling
from pyspark.sql import functions as F


def sequential(nodes, pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(max(a, b), set()).add(min(a, b))
    kept, out = set(), []
    for x in sorted(nodes):
        hits = near.get(x, set()) & kept
        if not hits:
            kept.add(x)
        out.append((x, not hits, min(hits, default=None)))
    return out


def cases():
    rng = random.Random(4)
    yield [(i, i + 1) for i in range(60)]  # a chain: every second one stays
    yield [(0, i) for i in range(1, 50)] + [(i, 99) for i in range(50)]  # hubs, first and last
    yield [(i, (i + 1) % 9) for i in range(9)] + [(3, 3), (20, 21), (21, 20)]
    yield [(rng.randrange(80), rng.randrange(80)) for _ in range(150)]
    yield []


@pytest.mark.parametrize("limits", [(3, 100_000), (1, 12)])
def test_greedy_set_equals_the_sequential_rule(rows, monkeypatch, limits):
    monkeypatch.setattr(graph, "ROUNDS", limits[0])
    monkeypatch.setattr(graph, "COMPONENT_EDGES", limits[1])
    # one graph of all cases, apart from each other
    pairs = [(1000 * k + a, 1000 * k + b) for k, case in enumerate(cases()) for a, b in case]
    if limits[1] < 100:  # the chain is too large for a task and goes by rounds: a short one will do
        pairs = [p for p in pairs if 1000 > p[0] and p[0] < 14 or 2000 <= p[0] < 3000]
    nodes = sorted({x for p in pairs for x in p} | {7_000, 7_001})
    got = graph.greedy_survivors(rows("id long", [(n,) for n in nodes]), rows("a long, b long", pairs))
    assert sorted(map(tuple, got.collect())) == sequential(nodes, pairs)


def test_greedy_set_of_nothing(rows):
    none = rows("a long, b long", [])
    assert graph.greedy_independent(none).count() == 0
    assert [tuple(r) for r in graph.greedy_survivors(rows("id long", [(3,)]), none).collect()] == [(3, True, None)]


def test_components(rows):
    edges = [(i, i + 1) for i in range(70)] + [(200, 100), (201, 200), (300, 300)] + [(400, 400 + i) for i in range(40)]
    got = dict(map(tuple, graph.components(rows("a long, b long", edges)).collect()))
    assert {got[i] for i in range(71)} == {0} and got[201] == got[200] == got[100] == 100 and got[439] == 400 and 300 not in got


def test_questions_of_chunks(rows):
    texts = {
        "c1": ("how do vectors work", "what is a vector"), "c2": ("how do vectors work?", "totally different words here"),
        "c3": ("totally different words here!", "unrelated xyz"), "c4": ("same same same", "same same same"),
    }
    table = rows("chunk_id string, variant string, question string", [(c, v, t) for c, both in texts.items() for v, t in zip(("direct", "paraphrase"), both)])
    grams = T.char_ngrams(F.col("question"), 2)
    got = sorted(map(tuple, pooling.dedupe_questions(table, grams, 0.85).collect()))
    # c2 goes, so that c3, which is like c2 alone, stays
    assert got == [("c1", True, None), ("c2", False, "c1"), ("c3", True, None), ("c4", True, None)]
    with pytest.raises(Exception, match="both variants"):
        pooling.dedupe_questions(table.where("variant = 'direct'"), grams).collect()
