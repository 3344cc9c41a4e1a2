import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import dense, fusion, lexical, metrics

DOCS = [("d_vector", "向量搜索索引使用距离函数"), ("d_backup", "备份恢复集群数据"), ("d_deploy", "部署 TiKV 集群"), ("d_sql", "SQL 向量 查询")]


def run_rows(rows, runs):
    return rows("query_id int, rank int, doc_id string, system string", [(q, i, d, s) for q, s, ids in runs for i, d in enumerate(ids, 1)])


def test_bm25_topic_first_and_query_terms_are_a_set(rows):
    docs = rows("doc_id string, text string", DOCS)
    q = rows("query_id int, text string", [(1, "向量检索"), (2, "向量向量检索"), (3, "不存在词"), (4, ""), (5, None)])
    got = lexical.bm25_topk(docs, q, 10).collect()
    first = {r["query_id"]: r["doc_id"] for r in got if r["rank"] == 1}
    assert first[1] == "d_sql" or first[1] == "d_vector"
    one = {r["doc_id"]: r["score"] for r in got if r["query_id"] == 1}
    two = {r["doc_id"]: r["score"] for r in got if r["query_id"] == 2}
    assert one == two
    assert not [r for r in got if r["query_id"] in (3, 4, 5)]


def test_sparse_search_equals_bm25_for_any_partitioning(rows):
    docs = rows("doc_id string, text string", [*DOCS, ("copy", DOCS[0][1]), ("none", None)])
    q = rows("query_id int, text string", [(1, "向量检索距离"), (2, "集群")])
    want = sorted(lexical.bm25_topk(docs, q, 10).collect())
    for n in (1, 7):
        d = docs.repartition(n)
        w = lexical.sparse_vectors(lexical.postings(d), lexical.lengths(d))
        got = sorted(lexical.sparse_search(w, lexical.query_terms(q), 10).select("query_id", "doc_id", "score", "rank").collect())
        assert got == want


def test_statistics_of_an_empty_collection(rows):
    docs = rows("doc_id string, text string", [])
    assert lexical.statistics(lexical.lengths(docs)).first()["avgdl"] == 1.0
    assert lexical.bm25_topk(docs, rows("query_id int, text string", [(1, "ab")]), 3).count() == 0


@pytest.mark.parametrize("include_self", [False, True])
def test_dense_blocks_of_queries_give_the_same_run(rows, monkeypatch, include_self):
    v = rows("doc_id int, v array<float>", [(i, [float(i * 7 % 11 + 1), float(i * 5 % 13 - 6), float(i % 3)]) for i in range(40)])
    q = v.where("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), "v")
    run = lambda: sorted(map(tuple, dense.dense_topk(v, q, 5, include_self).select("query_id", "doc_id", "score", "rank").collect()))
    want = run()
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 6)
    monkeypatch.setattr(dense, "CANDIDATE_BLOCK", 15, raising=False)
    assert run() == want and len(want) == 100


def test_dense_pairs_of_blocks_stay_apart(rows, monkeypatch):
    v = rows("doc_id int, v array<float>", [(i, [float(i * 7 % 11 + 1), float(i * 5 % 13 - 6), float(i % 3)]) for i in range(40)])
    q = v.where("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), "v")
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 2)  # ten blocks of queries
    assert dense.block_scores(v, q, 5).select(F.spark_partition_id().alias("p")).distinct().count() >= 6


def test_dense_ties_and_prefix(rows):
    v = rows("doc_id int, v array<float>", [(1, [1.0, 0.0, 5.0]), (2, [2.0, 0.0, 1.0]), (3, [0.0, 1.0, 0.0])])
    q = rows("query_id int, v array<float>", [(9, [1.0, 0.0, 0.0])])
    cut = v.withColumn("v", F.slice("v", 1, 2))
    got = dense.dense_topk(cut, q.withColumn("v", F.slice("v", 1, 2)), 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2]
    p = v.select(dense.prefix_normalised(F.col("v"), 2).alias("p")).collect()
    assert all(math.isclose(sum(x * x for x in r["p"]), 1) for r in p)
    for bad in ([(1, [0.0, 0.0])], [(1, [1.0])]):
        with pytest.raises(PySparkException):
            rows("doc_id int, v array<float>", bad).select(dense.prefix_normalised(F.col("v"), 2)).collect()


def test_rrf(rows):
    runs = run_rows(rows, [(1, "a", ["x", "a", "y"]), (1, "b", ["z", "b", "y"])])
    got = fusion.reciprocal_rank_fusion(runs, 60).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["y", "x", "z", "a", "b"]
    again = run_rows(rows, [(1, "a", ["x", "x", "y"])])
    assert [r["doc_id"] for r in fusion.reciprocal_rank_fusion(again, depth=2).orderBy("rank").collect()] == ["x"]
    w = lambda k: [r["doc_id"] for r in fusion.reciprocal_rank_fusion(runs, weights={"a": k, "b": 2 * k}).orderBy("rank").collect()]
    assert w(1.0) == w(3.0)


def test_rerank_keeps_prior_order_on_ties_and_the_tail(rows):
    run = run_rows(rows, [(1, "a", ["p", "q", "r", "s"])])
    scores = rows("query_id int, doc_id string, rerank_score double", [(1, "p", 0.5), (1, "q", 0.9), (1, "r", 0.5), (1, "s", 9.0)])
    got = fusion.rerank_prefix(run, scores, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["q", "p", "r", "s"]
    lost = scores.where("doc_id <> 'q'")
    assert fusion.missing_score_queries(run, lost, 3).count() == 1
    with pytest.raises(PySparkException):
        fusion.rerank_prefix(run, lost, 3).collect()


def test_metrics_score_unanswered_queries_zero(rows):
    run = run_rows(rows, [(1, "a", ["d1", "d2", "d3"])])
    qrels = rows("query_id int, doc_id string, grade int", [(1, "d2", 1), (1, "d9", 2), (2, "d1", 1)])
    got = {r["query_id"]: r for r in metrics.per_query(run, qrels, 10).collect()}
    assert got[1]["recall_k"] == 0.5 and got[1]["mrr_k"] == 0.5 and got[1]["hit_1"] == 0
    assert math.isclose(got[1]["ndcg_k"], (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got[2]["recall_k"] == got[2]["ndcg_k"] == 0
    graded = {r["query_id"]: r["ndcg"] for r in metrics.graded_ndcg(run, qrels).collect()}
    assert math.isclose(graded[1], (1 / math.log2(3)) / (3 + 1 / math.log2(3)), abs_tol=1e-9)
    outcome = {r["query_id"]: r["outcome"] for r in metrics.retrieval_outcome(run, qrels, near=1).collect()}
    assert outcome == {1: "ranking_failure", 2: "recall_failure"}
    cases = metrics.bad_cases(metrics.retrieval_outcome(run, qrels).withColumn("system", F.lit("a"))).first()
    assert (cases["success"], cases["recall_failure"], cases["success_rate"]) == (1, 1, 0.5)


def test_paired_counts(rows):
    b = rows("unit_id int, value double", [(1, 0.0), (2, 1.0), (3, 0.5), (4, 0.0)])
    t = rows("unit_id int, value double", [(1, 1.0), (2, 0.0), (3, 0.5), (4, 0.0)])
    r = metrics.win_loss_tie(b, t).first()
    assert (r["wins"], r["losses"], r["ties_zero"], r["ties_nonzero"], r["union_rate"]) == (1, 1, 1, 1, 0.75)
    c = metrics.contingency(b, t).first()
    assert (c["both_hit"], c["only_baseline"], c["only_treatment"], c["neither"], c["phi"]) == (1, 1, 1, 1, 0.0)
    assert metrics.contingency(b.where("value > 0"), t.where("value > 0")).first()["phi"] == 0


def test_dense_scores_tie_to_eight_places_and_are_those_of_pairs(rows):
    # cosines 1 and 1 - 1.25e-9: equal to eight places, so the smaller id is first; a null and a wider vector come last
    v = rows("doc_id int, v array<double>", [(1, [1.0, 5e-5]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0, 0.0, 0.0])])
    q = rows("query_id int, v array<double>", [(9, [1.0, 0.0])])
    got = dense.dense_topk(v, q, 9).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 4, 5] and [r["score"] is None for r in got] == [False] * 3 + [True] * 2
    assert got[0]["score"] < got[1]["score"] == 1
    pairs = {r["doc_id"]: r["score"] for r in dense.pair_scores(rows("query_id int, doc_id int", [(9, 1), (9, 3)]), v, q).collect()}
    assert pairs == {1: got[0]["score"], 3: got[2]["score"]}
    with pytest.raises(PySparkException):
        dense.dense_topk(rows("doc_id int, v array<double>", [(1, [0.0, 0.0])]), q, 1).collect()


def test_dense_copies_and_sequential_sums(rows):
    v = [(i, [float((i * 37 + j * 11) % 23 - 11) / 7 for j in range(24)]) for i in range(120)]
    data = v + [(1000 + i, v[5][1]) for i in range(300)]  # a large group of copies
    some = [(q, x) for q, x in data if q in (5, 7, 1003)]
    got = {}
    for r in dense.dense_topk(rows("doc_id int, v array<double>", data), rows("query_id int, v array<double>", some), 8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], float(r["score"])))
    for q, x in some:
        dot = lambda a, b: sum(s * t for s, t in zip(a, b))
        scored = [(-round(dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))), 8), d) for d, y in data if d != q]
        assert [(i, d) for i, d, _ in sorted(got[q])] == [(i, d) for i, (_, d) in enumerate(sorted(scored)[:8], 1)]


def test_counted_relevance_equals_listed_relevance(rows):
    data = [("a", 1, "d1"), ("a", 2, "d2"), ("b", 1, "d1"), ("c", 1, "d9")]
    run = rows("query_id string, rank int, doc_id string", data)
    listed = [("a", f"d{i}", 2 if i % 3 else 1) for i in range(2, 30)] + [("b", "d2", 1), ("c", "d9", 2), ("c", "d3", 2)]
    qrels = rows("query_id string, doc_id string, grade int", listed)
    found = rows("query_id string, n_gold long, grade int, rank int", [("a", 28, 2, 2), ("b", 1, None, None), ("c", 2, 2, 1)])
    n = F.max("n_gold")
    assert sorted(metrics.rank_metrics(found, n).collect()) == sorted(metrics.per_query(run, qrels).collect())
    assert sorted(metrics.rank_buckets(found).collect()) == sorted(metrics.first_gold_buckets(run, qrels).collect())
    assert sorted(metrics.rank_outcome(found).collect()) == sorted(metrics.retrieval_outcome(run, qrels).collect())
    grades = qrels.groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    assert sorted(metrics.graded_ndcg_of(found.where("rank is not null"), grades).collect()) == sorted(metrics.graded_ndcg(run, qrels).collect())


def test_all_vectors_of_a_label_are_relevant(spark, tmp_path):
    from quern.plans import registry

    data = [(i, [math.cos(i), math.sin(i)] + [0.5] * 62, i % 2) for i in range(700)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["ir_metrics"](spark, str(tmp_path)).collect()
    assert {r["query_id"]: r["n_gold"] for r in got} == {i: 349 for i in range(0, 700, 100)}
