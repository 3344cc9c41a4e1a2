"""Relevance judgements: qrels of query pairs, their pools, and how well runs are covered by them.

A pair is two questions, ``direct`` and ``paraphrase``, written from one chunk; both share one set of judgements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ingest import require
from .metrics import exact_mean
from .pooling import pool_union

VARIANTS = ("direct", "paraphrase")


def select_queries(qrels: DataFrame, tasks: list[str], limit: int | None = None) -> DataFrame:
    """``qrels(pos, task, ...)`` of the tasks; with a limit the first ones by pos (0 and None are no limit)."""
    rows = qrels.where(F.col("task").isin(list(tasks)))
    return rows.orderBy("pos").limit(limit) if limit else rows


def pair_variants(queries: DataFrame, columns: list[str]) -> DataFrame:
    """One row per chunk with ``direct_*`` and ``paraphrase_*`` of the columns; a chunk without exactly one query of
    each variant fails the job."""
    picked = [
        F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}") for v in VARIANTS for c in columns
    ]
    counts = [F.count_if(F.col("variant") == v).alias(f"_{v}") for v in VARIANTS]
    both = queries.groupBy("chunk_id").agg(F.count("*").alias("_n"), *counts, *picked)
    whole = require(both, (F.col("_n") == 2) & (F.col("_direct") == 1) & (F.col("_paraphrase") == 1), "a pair needs one query of each variant")
    return whole.drop("_n", "_direct", "_paraphrase")


def paired_pools(runs: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(query_id, doc_id, best_rank, systems, position) with one query_id per pair: its chunk_id.

    ``pairs(query_id, chunk_id)`` names the pair of each query. Within a system both queries' first ``depth`` documents
    make one list by (best rank, id); the lists of all systems make the pool, which always holds the pair's own chunk.
    """
    near = runs.where(F.col("rank") <= depth).join(pairs.select("query_id", "chunk_id"), "query_id")
    best = near.groupBy("system", F.col("chunk_id").alias("query_id"), "doc_id").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("system", "query_id").orderBy("best", "doc_id")
    own = pairs.select(F.col("chunk_id").alias("query_id"), F.col("chunk_id").alias("doc_id")).distinct()
    return pool_union(best.withColumn("rank", F.row_number().over(w)), 2 * depth + 1, own)


def expand_qrels(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query of ``judged(chunk_id, query_ids, gold_doc_ids, partial_doc_ids, judged_doc_ids,
    generator_chunk_grade)`` with the columns of ``queries``; a judged query that is not among them fails the job."""
    each = judged.select(
        F.explode("query_ids").alias("query_id"), "gold_doc_ids", "partial_doc_ids", "judged_doc_ids",
        F.col("chunk_id").alias("generating_chunk_id"), F.col("generator_chunk_grade").alias("generating_chunk_grade"),
    )
    known = queries.drop("gold_doc_ids", "partial_doc_ids", "judged_doc_ids", "generating_chunk_id", "generating_chunk_grade").withColumn("_known", F.lit(True))
    return require(each.join(known, "query_id", "left"), F.col("_known"), "a judged query was never written").drop("_known")


def collapse_to_sources(run: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): each source at its first chunk of ``run(query_id, rank, doc_id)``, ranks made gapless.

    ``sources(chunk_id, source)``; a chunk without source or twice in a run fails the job.
    """
    named = run.select("query_id", "rank", F.col("doc_id").alias("chunk_id")).join(sources.select("chunk_id", "source"), "chunk_id", "left")
    named = require(named, F.col("source").isNotNull(), "run contains an unknown chunk")
    chunks = named.groupBy("query_id", "chunk_id", "source").agg(F.min("rank").alias("rank"), F.count("*").alias("_n"))
    best = require(chunks, F.col("_n") == 1, "run contains a chunk twice").groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return best.select("query_id", F.col("source").alias("doc_id"), F.row_number().over(w).alias("rank"))


def source_qrels(qrels: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, pair_id, origin_source, confirmed_sources, partial_sources, judged_sources), the lists sorted.

    ``qrels(query_id, pair_id, variant, full, partial, judged, grade)``: pair_id is the generating chunk and grade its
    own; the chunk is in ``full`` whatever its grade, so it confirms its source only with grade 2 and is partial with 1.
    Confirmed sources are not partial. The job fails on an unknown chunk, an origin without grade-2 support, and a pair
    whose two queries differ.
    """
    named_as = lambda c: F.transform(F.col(c), lambda x: F.struct(F.lit(c).alias("kind"), x.alias("chunk_id")))
    lists = [named_as(c) for c in ("full", "partial", "judged")]
    origin = F.array(F.struct(F.lit("origin").alias("kind"), F.col("pair_id").alias("chunk_id")))
    rows = qrels.select("query_id", "pair_id", "variant", "grade", F.explode(F.concat(*lists, origin)).alias("x")).select("query_id", "pair_id", "variant", "grade", "x.*")
    rows = require(rows.join(sources.select("chunk_id", "source"), "chunk_id", "left"), F.col("source").isNotNull(), "qrels contain an unknown chunk")
    generating = F.col("chunk_id") == F.col("pair_id")
    named = lambda ok: F.sort_array(F.collect_set(F.when(ok, F.col("source"))))
    kind = F.col("kind")
    sets = rows.groupBy("query_id", "pair_id", "variant").agg(
        F.max(F.when(kind == "origin", F.col("source"))).alias("origin_source"),
        named((kind == "full") & (~generating | (F.col("grade") == 2))).alias("confirmed_sources"),
        named((kind == "partial") | ((kind == "origin") & (F.col("grade") == 1))).alias("_partial"),
        named(kind == "judged").alias("judged_sources"),
    )
    sets = sets.withColumn("partial_sources", F.array_except("_partial", "confirmed_sources"))
    sets = require(sets, F.array_contains("confirmed_sources", F.col("origin_source")), "origin source lacks grade-2 support")
    control = F.to_json(F.struct("origin_source", "confirmed_sources", "partial_sources", "judged_sources"))
    pair = Window.partitionBy("pair_id")
    same = sets.withColumn("_least", F.min(control).over(pair)).withColumn("_most", F.max(control).over(pair))
    same = require(same, F.col("_least") == F.col("_most"), "the queries of a pair have different sources")
    return same.select("query_id", "pair_id", "origin_source", "confirmed_sources", "partial_sources", "judged_sources")


def run_depths(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """(system, min, max, returned_1, returned_10) of the lengths of ``runs(system, query_id, rank, doc_id)``; a query
    without an answer has length 0."""
    systems = runs.select("system").distinct()
    length = runs.groupBy("system", "query_id").agg(F.count("*").alias("n"))
    all_ = queries.select("query_id").distinct().crossJoin(F.broadcast(systems))  # one row a system
    n = F.coalesce("n", F.lit(0))
    return all_.join(length, ["system", "query_id"], "left").groupBy("system").agg(
        F.min(n).alias("min"), F.max(n).alias("max"), F.count_if(n >= 1).alias("returned_1"), F.count_if(n >= 10).alias("returned_10")
    )


def coverage(runs: DataFrame, judged: DataFrame, queries: DataFrame, depth: int = 10) -> DataFrame:
    """How many queries have their first document, and their first ``depth``, wholly judged, per system.

    ``judged(query_id, doc_id)``. ``all_*`` counts queries whose returned documents are all judged (none returned
    counts), ``full_*`` only those that also returned that many.
    """
    systems = runs.select("system").distinct()
    known = judged.select("query_id", "doc_id").distinct().withColumn("_j", F.lit(True))
    rows = runs.where(F.col("rank") <= depth).join(known, ["query_id", "doc_id"], "left")
    new = F.col("_j").isNull()
    per = rows.groupBy("system", "query_id").agg(
        F.count("*").alias("n"), F.count_if(new & (F.col("rank") <= 1)).alias("u1"), F.count_if(new).alias("uk"),
    )
    every = queries.select("query_id").distinct().crossJoin(F.broadcast(systems)).join(per, ["system", "query_id"], "left")  # one row a system
    n, first, all_ = (F.coalesce(c, F.lit(0)) for c in ("n", "u1", "uk"))
    return every.groupBy("system").agg(
        F.count("*").alias("queries"), F.count_if(first == 0).alias("all_1"), F.count_if(all_ == 0).alias("all_k"),
        F.count_if((first == 0) & (n >= 1)).alias("full_1"), F.count_if((all_ == 0) & (n >= depth)).alias("full_k"),
        (F.count_if(first == 0) / F.count("*")).alias("all_1_rate"), (F.count_if(all_ == 0) / F.count("*")).alias("all_k_rate"),
    )


def pair_aggregates(pairs: DataFrame, batch: int = 10) -> DataFrame:
    """One row over ``pairs(pair_id, full, partial, judged, grade)``: pool sizes, gold arity, the grades as first given,
    promotions of generating chunks and judging batches.

    The generating chunk counts as gold whatever its ``grade``, so the first grades take it back. Pairs whose lists
    cannot come from any grades fail the job.
    """
    size, grade = F.size("judged"), F.col("grade")
    two = F.size("full") - (grade != 2).cast("int")
    one = F.size("partial") + (grade == 1).cast("int")
    rows = pairs.select(size.alias("s"), F.size("full").alias("g"), two.alias("two"), one.alias("one"), (size - two - one).alias("zero"), "grade")
    rows = require(rows, F.least("zero", "one", "two") >= 0, "qrels cannot come from any grades")
    return rows.agg(
        F.sum("s").alias("pool_total"), F.min("s").alias("pool_min"), F.avg("s").alias("pool_mean"), F.max("s").alias("pool_max"),
        *[F.sum(c).alias(f"grade_{i}") for i, c in enumerate(("zero", "one", "two"))],
        F.min("g").alias("arity_min"), F.avg("g").alias("arity_mean"), F.max("g").alias("arity_max"),
        *[F.count_if(F.col("grade") == i).alias(f"generating_{i}") for i in range(3)],
        F.count_if(F.col("grade") < 2).alias("promotions"), F.sum(F.ceil(F.col("s") / batch)).alias("batches"),
    )


def overlap_summary(rows: DataFrame, value: str = "overlap") -> DataFrame:
    """(variant, n, mean, p10, p50, p90) of ``rows(variant, id, value)``; percentiles are values at floor(n * share), the mean
    rounds to four places. No task holds a variant's values."""
    from .order import nearest_percentiles

    plain = rows.select("variant", F.col(value).alias("value"))
    p = nearest_percentiles(plain, ["variant"], [0.1, 0.5, 0.9])
    means = plain.groupBy("variant").agg(F.round(exact_mean(F.col("value")), 4).alias("mean"))
    at = lambda i, c: F.round(F.col("values")[i], 4).alias(c)
    return p.join(means, "variant").select("variant", "n", "mean", at(0, "p10"), at(1, "p50"), at(2, "p90"))


def dimension_variance(vectors: DataFrame, bands: int = 8) -> DataFrame:
    """(band, first, last, variance, ratio): mean population variance of ``vectors(v)`` over equal bands of dimensions,
    and its ratio to the mean over all; dimensions beyond the last whole band count only in the latter.

    Sums of a dimension are combined before the shuffle, which has one row a dimension and task.
    """
    each = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("var"))
    total = each.agg(F.count("*").alias("width"), F.avg("var").alias("overall"))
    width = F.floor(F.col("width") / bands)
    placed = each.crossJoin(F.broadcast(total)).withColumn("band", F.floor(F.col("dim") / width)).where(F.col("band") < bands)  # one row
    return placed.groupBy("band").agg(
        F.min("dim").alias("first"), F.max("dim").alias("last"), F.avg("var").alias("variance"), (F.avg("var") / F.max("overall")).alias("ratio")
    )


def interleave(runs: DataFrame) -> DataFrame:
    """(query_id, doc_id, position): the runs of each query of ``runs(query_id, run, rank, doc_id)`` taken in turns by
    (rank, run), each document once."""
    first = runs.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "run")).alias("at"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("position"))


def query_schedule(queries: DataFrame, count: int, seed: int) -> DataFrame:
    """(request, query_id): ``count`` requests over ``queries(pos, query_id)``, pos from 0, in a rotation that starts at
    seed mod n, so that every query is asked before one is asked again."""
    if count < 0:
        raise ValueError("the number of requests must not be negative")
    n = queries.count()
    if n == 0:
        raise ValueError("no queries to ask")
    requests = queries.sparkSession.range(count).select(F.col("id").alias("request"), ((F.col("id") + seed % n) % n).alias("pos"))
    return requests.join(queries.select("pos", "query_id"), "pos").select("request", "query_id")


def usage_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Token sums of ``calls(keys..., prompt, completion, reasoning)`` and how many calls report all three."""
    parts = ("prompt", "completion", "reasoning")
    complete = F.col("prompt").isNotNull() & F.col("completion").isNotNull() & F.col("reasoning").isNotNull()
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"{p}_tokens") for p in parts], F.count_if(complete).alias("calls_with_token_counts")
    )


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, count) of each column on its own, in one pass: themes of a sample, categories and splits of tasks."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("count"))


def no_sensitive_keys(df: DataFrame, keys: set[str]) -> DataFrame:
    """The frame itself, if no field of its schema at any depth has one of the names in any case."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def walk(kind, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                if f.name.lower() in keys:
                    raise ValueError(f"forbidden field {path}.{f.name}")
                walk(f.dataType, f"{path}.{f.name}")
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            walk(kind.valueType, f"{path}{{}}")

    walk(df.schema, "$")
    return df


# Lengths of a question in characters, and phrases that point at the passage it was written from.
MIN_QUESTION, MAX_QUESTION = 8, 60
SELF_REFERENCES = (
    "本文", "本节", "本章", "本页", "上文", "上述", "上表", "下表", "如上", "如下", "该章节", "该文档", "该表", "该片段", "这段", "这个表格", "文档中",
    "此处", "文中",
)


def question_fault(question: Column, phrases: tuple[str, ...] = SELF_REFERENCES) -> Column:
    """Why a question is refused, null if it is not: empty, short, long, or the first phrase of the list it holds."""
    held = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(question, p))
    return (
        F.when(F.coalesce(F.length(question), F.lit(0)) == 0, "invalid:empty question")
        .when(F.length(question) < MIN_QUESTION, f"invalid:question shorter than {MIN_QUESTION} characters")
        .when(F.length(question) > MAX_QUESTION, f"invalid:question longer than {MAX_QUESTION} characters")
        .when(F.size(held) > 0, F.concat(F.lit("invalid:self-reference '"), F.get(held, F.lit(0)), F.lit("'")))
    )


#: Axes of a verdict in the order of a report; the last one must be false.
AXES = ("answerable", "self_contained", "specific", "answer_supported", "same_intent", "leaks_answer")


def verdict_failures(row: dict[str, Column] | None = None) -> Column:
    """The axes on which a verdict refuses a question, none if it is kept; a null axis fails."""
    row = row or {a: F.col(a) for a in AXES}
    ok = {a: F.coalesce(~row[a] if a == "leaks_answer" else row[a], F.lit(False)) for a in AXES}
    return F.filter(F.array(*[F.when(~ok[a], F.lit(a)) for a in AXES]), lambda x: x.isNotNull())
