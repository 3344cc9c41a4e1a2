import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import families, judgements, sparse_index, stats

TEXTS = {1: "abcab", 2: "bcd ef", 3: "", 4: None, 5: "é向量搜索", 6: "a"}


def grams(text):
    s = "".join((text or "").split())
    return [s[i : i + 2] for i in range(len(s) - 1)] if len(s) > 1 else [s] if s else []


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3)


def plain(texts):
    lists = [grams(t) for t in texts.values()]
    df = {}
    for g in lists:
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    n, avgdl = len(lists), sum(map(len, lists)) / len(lists) or 1.0
    return {t: (i, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for i, t in enumerate(sorted(df))}, avgdl


def test_terms_are_numbered_by_code_point_and_encoded_under_frozen_statistics(spark, docs):
    index = sparse_index.build(docs)
    terms, avgdl = plain(TEXTS)
    got = {r["term"]: (r["term_index"], r["idf"]) for r in index.terms.collect()}
    assert got.keys() == terms.keys() and all(got[t][0] == terms[t][0] and got[t][1] == pytest.approx(terms[t][1]) for t in terms)
    later = spark.createDataFrame([(9, "abab zz"), (10, "zz"), (11, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["term_index"]): r["weight"] for r in sparse_index.encode_documents(index, later).collect()}
    tf, dl = {"ab": 2}, 5
    want = {(9, terms[t][0]): terms[t][1] * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) for t, f in tf.items()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)
    asked = spark.createDataFrame([(1, "bcbc zz"), (2, "")], "query_id long, text string")
    assert [tuple(r) for r in sparse_index.encode_queries(index, asked).collect()] == [(1, terms["bc"][0])]


def test_an_index_survives_storage_and_knows_its_collection(spark, docs, tmp_path):
    index = sparse_index.build(docs)
    sparse_index.write(index, str(tmp_path / "i"))
    again = sparse_index.read(spark, str(tmp_path / "i"))
    assert sorted(again.terms.collect()) == sorted(index.terms.collect())
    assert again.stats.collect() == index.stats.collect()
    assert sparse_index.same_collection(again, docs.repartition(5)).count() == 1
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 1, "abcac").otherwise(F.col("text")))
    with pytest.raises(Exception, match="collection changed"):
        sparse_index.same_collection(again, changed).collect()
    with pytest.raises(Exception):
        sparse_index.write(index, str(tmp_path / "i"))
    again.terms.where("term_index > 0").write.parquet(str(tmp_path / "j" / "terms"))
    again.stats.withColumn("terms", F.lit(len(plain(TEXTS)[0]))).write.json(str(tmp_path / "j" / "stats"))
    with pytest.raises(ValueError, match="vocabulary"):
        sparse_index.read(spark, str(tmp_path / "j"))


def test_ids_and_texts_cannot_be_shifted_in_the_fingerprint(spark):
    one = lambda a, b: sparse_index.fingerprint(spark.createDataFrame([(a, b)], "doc_id string, text string")).first()[0]
    assert len({one("1", "2:3"), one("1:2", "3"), one("1:2:3", "")}) == 3
    twice = spark.createDataFrame([("1", "x"), ("1", "x")], "doc_id string, text string")
    assert sparse_index.fingerprint(twice).first()[0] != one("1", "x")
    assert sparse_index.build(spark.createDataFrame([], "doc_id long, text string")).terms.count() == 0


def test_named_metrics_have_the_seeded_interval(rows):
    run = rows("query_id long, rank int, doc_id string", [(1, 1, "x"), (1, 2, "a"), (1, 3, "b"), (2, 1, "c")])
    qrels = rows("query_id long, doc_id string, grade int", [(1, "a", 1), (1, "b", 1), (2, "c", 2), (3, "d", 1), (2, "z", 0)])
    got = {r["metric"]: r for r in families.evaluate(run, qrels, resamples=300).collect()}
    ndcg = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    for name, values in {"R@1": [0, 1, 0], "MRR@10": [0.5, 1, 0], "nDCG@10": [ndcg, 1, 0]}.items():
        want = stats.bootstrap_ci(values, resamples=300)
        assert [got[name][k] for k in ("mean", "low", "high", "n")] == pytest.approx([want[k] for k in ("mean", "low", "high", "n")])
    own = families.evaluate(run, qrels, {"hits": families.hit(2), "all": families.all_found(3)}, resamples=10)
    assert {r["metric"]: r["mean"] for r in own.collect()} == pytest.approx({"hits": 2 / 3, "all": 2 / 3})


def test_a_family_equals_the_plain_functions(rows):
    rng = random.Random(3)
    values = {(arm, m): [rng.choice([0.0, 0.5, 1.0]) for _ in range(20)] for arm in ("base", "new") for m in ("m1", "m2")}
    values["new", "m1"] = [1.0] * 20
    data = [(1, arm, m, i, None, v) for (arm, m), vs in values.items() for i, v in enumerate(vs)]
    scores = rows("arity int, arm string, metric string, unit_id long, cluster string, value double", data)
    got = {r["metric"]: r for r in families.paired_family(scores, ["arity"], [("base", "new")], binary=False, resamples=400).collect()}
    ps = {m: stats.paired_bootstrap_p(values["base", m], values["new", m], resamples=400) for m in ("m1", "m2")}
    floors = stats.holm_floor_flags({f"1/{m}/base/new": (p, p <= stats.p_floor(400) + 1e-12) for m, p in ps.items()})
    low, high = sorted(ps, key=ps.get)
    adjusted = {low: min(1, 2 * ps[low])}
    adjusted[high] = max(adjusted[low], ps[high])
    for m in ps:
        diffs = [t - b for b, t in zip(values["base", m], values["new", m])]
        ci = stats.bootstrap_ci(diffs, resamples=400)
        r = got[m]
        assert (r["p"], r["adjusted"]) == pytest.approx((ps[m], adjusted[m]))
        assert (r["delta"], r["low"], r["high"]) == pytest.approx((ci["mean"], ci["low"], ci["high"]))
        assert r["wins"] == sum(d > 0 for d in diffs) and r["losses"] == sum(d < 0 for d in diffs)
        assert r["adjusted_at_floor"] == floors[f"1/{m}/base/new"]
    with pytest.raises(Exception, match="same units"):
        families.paired_family(scores.where("not (arm = 'new' and unit_id = 3)"), ["arity"], [("base", "new")], binary=False, resamples=5).collect()


def test_a_binary_family_takes_the_exact_test(rows):
    before, after = [0, 0, 0, 0, 0, 1, 1, 0], [1, 1, 1, 1, 1, 1, 0, 0]
    data = [(arm, "hit", i, None, float(v)) for arm, vs in (("b", before), ("t", after)) for i, v in enumerate(vs)]
    scores = rows("arm string, metric string, unit_id long, cluster string, value double", data)
    r = families.paired_family(scores, [], [("b", "t")], binary=True, resamples=50).first()
    assert r["p"] == pytest.approx(stats.mcnemar_exact(1, 5)) and not r["at_floor"] and r["adjusted"] == pytest.approx(r["p"])


def test_interaction(rows):
    data = [(1, "c", v, a, x) for v, a, x in (("direct", "b", 0.5), ("direct", "n", 0.6), ("paraphrase", "b", 0.2), ("paraphrase", "n", 0.7))]
    scores = rows("unit_id long, cluster string, variant string, arm string, value double", data)
    assert families.interaction(scores, "b", "n").first()["value"] == pytest.approx(0.4)
    with pytest.raises(Exception, match="four scores"):
        families.interaction(scores.where("not (variant = 'direct' and arm = 'n')"), "b", "n").collect()


def test_pairs_and_their_qrels(rows):
    queries = rows("query_id long, chunk_id string, variant string, answer string", [(1, "a", "direct", "x"), (2, "a", "paraphrase", "y")])
    r = judgements.pair_variants(queries, ["query_id", "answer"]).first()
    assert (r["direct_query_id"], r["paraphrase_query_id"], r["direct_answer"], r["paraphrase_answer"]) == (1, 2, "x", "y")
    with pytest.raises(Exception, match="one query of each variant"):
        judgements.pair_variants(queries.where("query_id = 1"), ["query_id"]).collect()
    judged = rows(
        "chunk_id string, query_ids array<long>, gold_doc_ids array<string>, partial_doc_ids array<string>, judged_doc_ids array<string>, generator_chunk_grade int",
        [("a", [1, 2], ["a", "b"], ["c"], ["a", "b", "c", "d"], 1)],
    )
    out = judgements.expand_qrels(judged, queries).orderBy("query_id").collect()
    assert [r["query_id"] for r in out] == [1, 2] and all(r["gold_doc_ids"] == ["a", "b"] and r["generating_chunk_grade"] == 1 for r in out)
    assert {r["answer"] for r in out} == {"x", "y"}
    with pytest.raises(Exception, match="never written"):
        judgements.expand_qrels(judged, queries.where("query_id = 1")).collect()


QRELS = "query_id long, pair_id string, variant string, full array<string>, partial array<string>, judged array<string>, grade int"


def test_source_qrels_take_promoted_chunks_back(rows):
    sources = rows("chunk_id string, source string", [("a", "s1"), ("b", "s1"), ("c", "s2"), ("d", "s3"), ("e", "s3")])
    row = ("a", "direct", ["a", "b", "c"], ["d"], ["a", "b", "c", "d", "e"], 1)
    two = [(1, *row), (2, row[0], "paraphrase", *row[2:])]
    out = judgements.source_qrels(rows(QRELS, two), sources).orderBy("query_id").collect()
    assert [tuple(r)[2:] for r in out] == [("s1", ["s1", "s2"], ["s3"], ["s1", "s2", "s3"])] * 2
    with pytest.raises(Exception, match="grade-2 support"):
        judgements.source_qrels(rows(QRELS, [(1, "a", "direct", ["a", "c"], [], ["a", "c"], 1)]), sources).collect()
    with pytest.raises(Exception, match="unknown chunk"):
        judgements.source_qrels(rows(QRELS, [(1, "a", "direct", ["a", "zz"], [], ["a"], 2)]), sources).collect()
    with pytest.raises(Exception, match="different sources"):
        judgements.source_qrels(rows(QRELS, [two[0], (2, "a", "paraphrase", ["a", "b"], ["d"], ["a"], 2)]), sources).collect()


def test_pair_aggregates(rows):
    fine = rows(QRELS, [(1, "a", "direct", ["a", "b"], ["c"], ["a", "b", "c", "d"], 0)])
    r = judgements.pair_aggregates(fine, 3).first()
    assert [r[f"grade_{i}"] for i in range(3)] == [2, 1, 1] and (r["promotions"], r["batches"], r["arity_max"]) == (1, 2, 2)
    with pytest.raises(Exception, match="cannot come"):
        judgements.pair_aggregates(rows(QRELS, [(1, "a", "direct", ["a", "b"], ["c"], ["a"], 2)]), 3).collect()


def test_collapse_keeps_the_first_chunk_of_a_source(rows):
    run = rows("query_id long, rank int, doc_id string", [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d")])
    sources = rows("chunk_id string, source string", [("a", "s1"), ("b", "s1"), ("c", "s2"), ("d", "s1")])
    assert [tuple(r) for r in judgements.collapse_to_sources(run, sources).orderBy("rank").collect()] == [(1, "s1", 1), (1, "s2", 2)]
    with pytest.raises(Exception, match="unknown chunk"):
        judgements.collapse_to_sources(run, sources.where("chunk_id <> 'd'")).collect()
    with pytest.raises(Exception, match="twice"):
        judgements.collapse_to_sources(run.union(run.where("rank = 1")), sources).collect()


def test_depth_and_coverage_count_queries_without_answers(rows):
    runs = rows("system string, query_id long, rank int, doc_id string", [("x", 1, 1, "a"), ("x", 1, 2, "b"), ("y", 2, 1, "c")])
    asked = rows("query_id long", [(1,), (2,), (3,)])
    depth = {r["system"]: tuple(r)[1:] for r in judgements.run_depths(runs, asked).collect()}
    assert depth == {"x": (0, 2, 1, 0), "y": (0, 1, 1, 0)}
    judged = rows("query_id long, doc_id string", [(1, "a"), (2, "zz")])
    got = {r["system"]: r for r in judgements.coverage(runs, judged, asked, depth=2).collect()}
    assert (got["x"]["all_1"], got["x"]["all_k"], got["x"]["full_1"], got["x"]["full_k"]) == (3, 2, 1, 0)
    assert (got["y"]["all_1"], got["y"]["full_1"]) == (2, 0)


def test_pools_of_pairs_merge_questions_before_systems(rows):
    runs = rows("system string, query_id long, rank int, doc_id long", [("x", 1, 1, 7), ("x", 2, 1, 8), ("x", 2, 2, 7), ("y", 1, 1, 9), ("y", 1, 3, 5)])
    pairs = rows("query_id long, chunk_id long", [(1, 100), (2, 100)])
    got = [(r["doc_id"], r["best_rank"], r["systems"]) for r in judgements.paired_pools(runs, pairs, 2).orderBy("position").collect()]
    assert got == [(7, 1, ["x"]), (9, 1, ["y"]), (8, 2, ["x"]), (100, 6, [])]


def test_small_reports(spark, rows):
    runs = rows("query_id long, run int, rank int, doc_id string", [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "c"), (1, 1, 2, "a")])
    assert [r["doc_id"] for r in judgements.interleave(runs).orderBy("position").collect()] == ["a", "c", "b"]
    asked = rows("pos long, query_id string", [(0, "a"), (1, "b"), (2, "c")])
    assert [r["query_id"] for r in judgements.query_schedule(asked, 5, 4).orderBy("request").collect()] == ["b", "c", "a", "b", "c"]
    calls = rows("m string, prompt int, completion int, reasoning int", [("x", 3, 1, None), ("x", 2, 2, 2)])
    assert tuple(judgements.usage_totals(calls, ["m"]).first()) == ("x", 2, 5, 3, 2, 1)
    tasks = rows("category string, split string", [("a", "dev"), ("a", "test"), (None, "dev")])
    assert sorted(map(tuple, judgements.counts_by(tasks, ["category", "split"]).collect()), key=repr) == [
        ("category", "a", 2), ("category", None, 1), ("split", "dev", 2), ("split", "test", 1)]
    overlap = rows("variant string, id long, overlap double", [("direct", i, i / 10) for i in range(10)])
    assert tuple(judgements.overlap_summary(overlap).first()) == ("direct", 10, 0.45, 0.1, 0.5, 0.9)
    v = rows("v array<double>", [([0.0] * 4 + [1.0] * 4,), ([2.0] * 4 + [1.0] * 4,)])
    assert [tuple(r)[1:] for r in judgements.dimension_variance(v, 2).orderBy("band").collect()] == [(0, 3, 1.0, 2.0), (4, 7, 0.0, 0.0)]
    with pytest.raises(ValueError, match=r"\$\.a\[\]\.API_key"):
        judgements.no_sensitive_keys(spark.sql("select array(named_struct('API_key', 1)) as a"), {"api_key"})


def test_selection_faults_and_verdicts(rows):
    qrels = rows("pos long, task string", [(2, "a"), (0, "b"), (1, "a")])
    assert [r["pos"] for r in judgements.select_queries(qrels, ["a"], 1).collect()] == [1]
    assert judgements.select_queries(qrels, ["a"], 0).count() == 2
    texts = [None, "", "short", "x" * 61, "如何配置本文上述参数", "如何配置连接参数呢"]
    got = [r[0] for r in rows("i int, q string", list(enumerate(texts))).orderBy("i").select(judgements.question_fault(F.col("q"))).collect()]
    assert got == ["invalid:empty question"] * 2 + [
        "invalid:question shorter than 8 characters", "invalid:question longer than 60 characters", "invalid:self-reference '本文'", None]
    axes = rows(", ".join(f"{a} boolean" for a in judgements.AXES), [(True,) * 5 + (False,), (True, False, True, None, True, True)])
    assert [r[0] for r in axes.select(judgements.verdict_failures()).collect()] == [[], ["self_contained", "answer_supported", "leaks_answer"]]
