import math
import random
from itertools import product

import pytest

from quern.operators import pooling, stats


def test_bootstrap_matches_a_plain_loop():
    values = [0.0, 1.0, 0.5, 0.25, 1.0]
    rng = random.Random(3)
    means = sorted(sum(rng.choices(values, k=5)) / 5 for _ in range(400))
    got = stats.bootstrap_ci(values, resamples=400, seed=3)
    assert (got["low"], got["high"], got["n"]) == (means[int(0.025 * 400)], means[min(int(0.975 * 400), 399)], 5)
    assert math.isclose(got["mean"], 0.55)
    clusters = stats.bootstrap_ci(values, ["a", "a", "b", "b", "c"], resamples=100)
    assert clusters["n"] == 3 and clusters["low"] <= clusters["mean"] <= clusters["high"]
    for bad in ([], [math.nan]):
        with pytest.raises(ValueError):
            stats.bootstrap_ci(bad)


def test_paired_p_values():
    b, t = [0.0] * 12, [1.0] * 11 + [0.0]
    assert stats.paired_bootstrap_p(b, t, resamples=500) == stats.p_floor(500)
    assert stats.paired_bootstrap_p(b, b, resamples=50) == 1
    assert stats.paired_bootstrap_p(t, b, resamples=200) > 0.9
    with pytest.raises(ValueError):
        stats.paired_bootstrap_p(b, t, alternative="less")


def test_mcnemar_closed_form():
    assert stats.mcnemar_exact(0, 5, "greater") == 1 / 32
    assert stats.mcnemar_exact(0, 5) == 1 / 16
    assert stats.mcnemar_exact(3, 3) == 1 and stats.mcnemar_exact(0, 0) == 1
    assert 0 < stats.mcnemar_exact(400, 600) < 1e-9


def test_permutation_enumerates():
    d = [0.3, -0.1, 0.2, 0.0]
    seen = abs(sum(d))
    want = sum(abs(sum(s * x for s, x in zip(signs, d[:3]))) >= seen - 1e-12 for signs in product((1, -1), repeat=3)) / 8
    assert stats.group_permutation(d) == (want, True)
    p, exact = stats.group_permutation([1.0] * 20, resamples=100)
    assert not exact and p <= 3 / 101


def test_holm(rows):
    data = [("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.5), ("g", "x", 0.9)]
    got = {r["name"]: (r["adjusted"], r["reject"]) for r in stats.holm(rows("family string, name string, p double", data)).collect()}
    assert got["a"] == (0.04, True) and got["c"][0] == got["b"][0] == 0.09 and not got["b"][1] and got["x"] == (0.9, False)
    flags = stats.holm_floor_flags({"a": (0.001, True), "b": (0.001, True), "c": (0.4, False)})
    assert flags == {"a": True, "b": True, "c": False}


def test_hash_bootstrap_does_not_depend_on_partitions(rows):
    df = rows("k string, cluster string, num double, den double", [("a", str(i), float(i % 3), 2.0) for i in range(9)] + [("z", "0", 1.0, 0.0)])
    one = sorted(stats.hash_bootstrap(df.repartition(1), ["k"], 50).collect())
    assert one == sorted(stats.hash_bootstrap(df.repartition(7), ["k"], 50).collect())
    a = one[0]
    assert a["low"] <= a["mean"] <= a["high"] and a["n"] == 9
    assert one[1]["mean"] is None and one[1]["low"] is None


def test_pools(rows):
    runs = rows("system string, query_id int, rank int, doc_id string", [("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 1, 1, "y"), ("b", 1, 3, "z")])
    need = rows("query_id int, doc_id string", [(1, "q"), (1, "x")])
    pool = pooling.pool_union(runs, 2, need)
    got = [(r["doc_id"], r["best_rank"], r["systems"]) for r in pool.orderBy("position").collect()]
    assert got == [("x", 1, ["a"]), ("y", 1, ["a", "b"]), ("q", 3, [])]
    count = {r["name"]: r["candidates"] for r in pooling.pool_contribution(pool).collect()}
    assert count == {"a": 2, "b": 1, "unique_candidates": 3, "exclusive_to_one_system": 1}
    one, two = (sorted((r["doc_id"], r["judging_position"]) for r in pooling.judging_order(p, "s").collect()) for p in (pool, pool.repartition(5)))
    assert one == two


def test_stratified_sample_gives_small_themes_a_seat(rows):
    df = rows("id int, theme string", [(i, "big") for i in range(94)] + [(100 + i, "small") for i in range(6)])
    got = pooling.stratified_sample(df, "theme", "id", 10, "s").collect()
    assert len(got) == 10 and {r["theme"] for r in got} == {"big", "small"}
    assert sorted(got) == sorted(pooling.stratified_sample(df.repartition(3), "theme", "id", 10, "s").collect())


def test_tertiles_keep_ties_together(rows):
    got = pooling.overlap_tertiles(rows("id int, v int", [(i, 0) for i in range(6)] + [(9, 1), (10, 2), (11, 3)]), "v").collect()
    strata = {}
    for r in got:
        strata.setdefault(r["v"], set()).add(r["stratum"])
    assert all(len(s) == 1 for s in strata.values()) and strata[3] == {"high"}


def test_near_questions_and_greedy(rows):
    from pyspark.sql import functions as F

    from quern.functions.text import char_ngrams

    texts = ["how to back up data", "how to back up data?", "how to back up datas", "something else", ""]
    got = pooling.near_questions(rows("id int, text string", list(enumerate(texts))), char_ngrams(F.col("text"), 2), "id", 0.8).collect()
    grams = [set(map("".join, zip(s, s[1:]))) for s in ("".join(t.split()) for t in texts)]
    want = {(i, j) for i in range(5) for j in range(i + 1, 5) if grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8}
    assert {(r["earlier"], r["later"]) for r in got} == want
    assert pooling.greedy_survivors([(0, 1), (1, 2)], [0, 1, 2]) == ([0, 2], [(1, 0)])


def test_near_questions_in_blocks_are_those_of_prefixes(rows, monkeypatch):
    from pyspark.sql import functions as F

    from quern.functions.text import char_ngrams

    texts = ["".join("abcd"[(i * i // 7 + i * j + j // 3) % 4] for j in range(4 + i % 9)) for i in range(90)] + ["", "a", None, "abab", "abab"]
    table = rows("id int, text string", list(enumerate(texts))).select(F.struct("id").alias("id"), "text")
    grams = char_ngrams(F.col("text"), 2)
    run = lambda: sorted(map(tuple, pooling.near_questions(table, grams, "id", 0.5).select("earlier.id", "later.id", "similarity").toDF("a", "b", "s").collect()))
    monkeypatch.setattr(pooling, "PREFIX_PAIRS", 10**9)
    want = run()
    monkeypatch.setattr(pooling, "PREFIX_PAIRS", 0)
    assert run() == want and len(want) > 100
    for name, value in (("BLOCK_SETS", 8), ("BLOCK_GRAMS", 3), ("GROUP_SETS", 20)):
        monkeypatch.setattr(pooling, name, value)
    made = []
    monkeypatch.setattr(pooling, "block_pairs", lambda *a, f=pooling.block_pairs: made.append(1) or f(*a))
    assert run() == want and made
