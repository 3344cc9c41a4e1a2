"""Judgement pools, ordered samples and question deduplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.text import keyed_digest
from quern.sources.staging import Staging

from . import graph
from .ingest import require

#: Pairs of prefixes a set beyond which all sets are compared in blocks; sets and grams of a block, sets of a group, and groups
#: (28 pairs of them) where there are enough sets.
PREFIX_PAIRS, BLOCK_SETS, BLOCK_GRAMS, GROUP_SETS, GROUPS = 50, 2048, 4096, 32_768, 7
SAMPLE_SCHEMA, ORDER_SCHEMA = "quern-sample-v1", "quern-judging-order-v1"


def pool_union(runs: DataFrame, depth: int, required: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, best_rank, systems, position): the first ``depth`` of every run of ``runs(system, query_id,
    rank, doc_id)``, and ``required(query_id, doc_id)`` at depth + 1 without contributor."""
    rows = runs.where(F.col("rank") <= depth).select("query_id", "doc_id", "rank", "system")
    if required is not None:
        rows = rows.unionByName(required.select("query_id", "doc_id", F.lit(depth + 1).alias("rank"), F.lit(None).cast("string").alias("system")))
    w = Window.partitionBy("query_id").orderBy("best_rank", "doc_id")
    return (
        rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best_rank"), F.sort_array(F.collect_set("system")).alias("systems"))
        .withColumn("position", F.row_number().over(w))
    )


def pool_contribution(pool: DataFrame) -> DataFrame:
    """(name, candidates): per system, all, and those of one system only."""
    each = pool.select(F.explode("systems").alias("name")).groupBy("name").agg(F.count("*").alias("candidates"))
    both = pool.agg(F.count("*").alias("unique_candidates"), F.count_if(F.size("systems") == 1).alias("exclusive_to_one_system"))
    return each.unionByName(both.selectExpr("stack(2, 'unique_candidates', unique_candidates, 'exclusive_to_one_system', exclusive_to_one_system) as (name, candidates)"))


def judging_order(pool: DataFrame, seed: str, batch: int = 10) -> DataFrame:
    """Adds ``judging_position`` from 1 by keyed digest and the fixed-size ``batch`` it falls in."""
    digest = keyed_digest(ORDER_SCHEMA, seed, F.col("doc_id").cast("string"))
    w = Window.partitionBy("query_id").orderBy(digest)
    return pool.withColumn("judging_position", F.row_number().over(w)).withColumn("batch", F.floor((F.col("judging_position") - 1) / batch))


def stratified_sample(rows: DataFrame, theme: str, ident: str, size: int, seed: str) -> DataFrame:
    """``size`` rows, allotted to themes by largest remainder and drawn within a theme by keyed digest.

    The allotment is over the table of themes; a theme takes no more than it has. The draw ranks each theme's rows by
    digest with a group limit before the shuffle.
    """
    counts = rows.groupBy(theme).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    exact = counts.crossJoin(F.broadcast(total)).withColumn("_e", F.lit(size) * F.col("_c") / F.col("_t")).withColumn("_q", F.floor("_e"))  # one row
    order = Window.orderBy(F.desc(F.col("_e") - F.col("_q")), theme)
    left = F.lit(size) - F.sum("_q").over(Window.partitionBy())
    quota = exact.withColumn("_quota", F.col("_q") + (F.row_number().over(order) <= left).cast("long")).select(theme, "_quota")
    digest = keyed_digest(SAMPLE_SCHEMA, seed, F.col(ident).cast("string"))
    w = Window.partitionBy(theme).orderBy(digest, ident)
    ranked = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size)
    return ranked.join(F.broadcast(quota), theme).where(F.col("_n") <= F.col("_quota")).drop("_n", "_quota")


def overlap_tertiles(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``stratum``: low, middle or high by the mid-distribution of the value; equal values share a stratum.

    A value is low if the rows below it and half of its own are a third of all at most, middle up to two thirds. So the value
    at the rank of each third is a bound, and its own rows are counted to tell on which side they are.
    """
    from .order import select_ranks

    counted = rows.where(F.col(value).isNotNull())
    n = counted.count()
    plain = counted.select(F.lit(1).alias("all"), F.col(value).alias("value"))
    targets = rows.sparkSession.createDataFrame([(1, 0, n // 3), (1, 1, 2 * n // 3)], "all int, j int, k long")
    bounds = {r["j"]: r["value"] for r in select_ranks(plain, targets, ["all"]).collect()}  # two values
    if not bounds:
        return counted.withColumn("stratum", F.lit("low"))
    at = {j: counted.agg(F.count_if(F.col(value) < v).alias("b"), F.count_if(F.col(value) == v).alias("c")).first() for j, v in bounds.items()}
    upto = lambda j: (F.col(value) <= bounds[j]) if 3 * (2 * at[j]["b"] + at[j]["c"]) <= 2 * (j + 1) * n else (F.col(value) < bounds[j])
    return counted.withColumn("stratum", F.when(upto(0), "low").when(upto(1), "middle").otherwise("high"))


def complete_pairs(queries: DataFrame) -> DataFrame:
    """Queries of chunks that have both variants."""
    whole = queries.groupBy("chunk_id").agg(F.count_distinct("variant").alias("k")).where("k = 2").select("chunk_id")
    return queries.join(whole, "chunk_id", "left_semi")


def set_rows(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and member of each member of the lists."""
    flat = pa.concat_arrays(lists.chunks)
    return pc.list_parent_indices(flat).to_numpy(), flat.flatten().to_numpy()


def shared_counts(left: tuple, right: tuple, first: int, other: int) -> np.ndarray:
    """[left, right]: how many members the sets of BLOCK_SETS rows from ``first`` and from ``other`` on share."""
    near = lambda rows, start: slice(*np.searchsorted(rows, (start, start + BLOCK_SETS)))
    at, to = near(left[0], first), near(right[0], other)
    common, x, y = np.intersect1d(left[1][at], right[1][to]), left[1][at], right[1][to]
    counts = np.zeros((BLOCK_SETS, BLOCK_SETS), np.float32)
    for start in range(0, len(common), BLOCK_GRAMS):
        part = common[start : start + BLOCK_GRAMS]
        both = []
        for rows, members in ((left[0][at] - first, x), (right[0][to] - other, y)):
            place = np.searchsorted(part, members)
            place[place == len(part)] = 0
            here = part[place] == members
            table = np.zeros((BLOCK_SETS, len(part)), np.float32)
            table[rows[here], place[here]] = 1
            both.append(table)
        counts += both[0] @ both[1].T
    return counts


def block_pairs(sets: DataFrame, count: int, threshold: float) -> DataFrame:
    """(earlier, later, similarity) of ``sets(id, n, g)``, every pair compared once: sets are dealt into groups, and each pair
    of groups is one task's work, which multiplies tables of sets by grams, BLOCK_SETS rows at a time. The work is that
    of all pairs; only pairs over the threshold leave a task."""
    groups = max(-(-count // GROUP_SETS), min(GROUPS, -(-count // BLOCK_SETS)))
    p, x = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = sets.withColumn("p", p).withColumn("x", x).select("id", "n", "g", "p", F.least("p", "x").alias("i"), F.greatest("p", "x").alias("j"))
    kind = sets.schema["id"].dataType
    empty = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind)), ("n", pa.int32()), ("c", pa.int32())]).empty_table()

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        left = table.filter(pc.equal(table["p"], i))
        right = left if i == j else table.filter(pc.equal(table["p"], j))
        if not (left.num_rows and right.num_rows):
            return empty
        sizes = [t["n"].to_numpy().astype(np.float64) for t in (left, right)]
        members, out = [set_rows(t["g"]) for t in (left, right)], []
        for first in range(0, left.num_rows, BLOCK_SETS):
            for other in range(first if i == j else 0, right.num_rows, BLOCK_SETS):
                n_a, n_b = sizes[0][first : first + BLOCK_SETS], sizes[1][other : other + BLOCK_SETS]
                c = shared_counts(*members, first, other)[: len(n_a), : len(n_b)]
                share = threshold / (1 + threshold)
                a, b = np.nonzero((c > 0) & (c >= (share * n_a - 1e-3).astype(np.float32)[:, None] + (share * n_b).astype(np.float32)))
                shared, n = c[a, b].astype(np.float64), n_a[a] + n_b[b]
                ok = shared / (n - shared) >= threshold
                if i == j and first == other:
                    ok &= a < b
                out.append((a[ok] + first, b[ok] + other, n[ok], shared[ok]))
        a, b, n, c = (np.concatenate(x) for x in zip(*out))
        columns = [left["id"].take(pa.array(a)), right["id"].take(pa.array(b)), pa.array(n.astype(np.int32)), pa.array(c.astype(np.int32))]
        return pa.table(columns, ["a", "b", "n", "c"])

    kind = kind.simpleString()
    dealt = dealt.repartition(groups * (groups + 1), "i", "j")  # so that pairs of groups seldom share a task
    found = dealt.groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, n int, c int")
    similarity = F.col("c") / (F.col("n") - F.col("c"))
    return found.select(F.least("a", "b").alias("earlier"), F.greatest("a", "b").alias("later"), similarity.alias("similarity"))


def near_questions(rows: DataFrame, grams: Column, ident: str, threshold: float) -> DataFrame:
    """(earlier, later, similarity): pairs with Jaccard similarity >= threshold, proposed by prefix filtering.

    A set is the 64-bit hashes of its grams, rare first. Two sets over the threshold share one of the first
    n - ceil(threshold * n) + 1, have sizes within the threshold, and enough grams behind the shared one (positional
    filter): all is known where prefixes meet, before pairs are made. A pair's sets are intersected once.
    The pairs whose prefixes meet are counted first. Where they are more than PREFIX_PAIRS a set, as in texts of few
    different grams, all sets are compared in blocks instead (``block_pairs``), and only what is similar is written.
    """
    gram = rows.select(F.col(ident).alias("id"), F.explode(F.array_distinct(grams)).alias("gram")).select("id", F.xxhash64("gram").alias("h"))
    df = gram.groupBy("h").agg(F.count("*").alias("df"))
    ordered = gram.join(df, "h").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s"))
    sets = Staging(rows.sparkSession, "questions").table(ordered.select("id", F.size("s").alias("n"), F.col("s.h").alias("g")))
    prefix = sets.select("id", "n", F.posexplode(F.slice("g", F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int"))).alias("at", "h"))
    met = prefix.groupBy("h").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0]
    if (met or 0) > PREFIX_PAIRS * (count := sets.count()):
        return block_pairs(sets, count, threshold)
    a, b = (prefix.select("h", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), (F.col("n") - F.col("at")).alias(f"rest_{x}")) for x in ("earlier", "later"))
    both = F.col("n_earlier") + F.col("n_later")
    pairs = a.join(b, "h").where(
        (F.col("earlier") < F.col("later")) & (F.least("n_earlier", "n_later") >= F.lit(threshold) * F.greatest("n_earlier", "n_later"))
        & (F.least("rest_earlier", "rest_later") * (1 + threshold) >= both * threshold - 1e-9)
    ).select("earlier", "later").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("g").alias(f"g_{x}"))
    joined = pairs.join(side("earlier"), "earlier").join(side("later"), "later")
    counted = joined.select("earlier", "later", both.alias("n"), F.size(F.array_intersect("g_earlier", "g_later")).alias("c"))
    return counted.select("earlier", "later", (F.col("c") / (F.col("n") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= threshold)


def greedy_survivors(pairs: list[tuple], idents: list) -> tuple[list, list[tuple]]:
    """(kept, [(dropped, kept one it repeats)]) in order of id: only what is kept suppresses. The rule for a handful of
    questions at hand; ``dedupe_questions`` applies it to tables."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    kept, gone, alive = [], [], set()
    for x in sorted(idents):
        hit = min((a for a in near.get(x, []) if a in alive), default=None)
        if hit is None:
            kept.append(x)
            alive.add(x)
        else:
            gone.append((x, hit))
    return kept, gone


def dedupe_questions(rows: DataFrame, grams: Column, threshold: float = 0.85) -> DataFrame:
    """(chunk_id, kept, repeats) for the chunks of ``rows(chunk_id, variant, ...)``: in order of chunk_id, a chunk goes if any
    of its questions is similar to any question of a chunk that stays; ``repeats`` is the first such chunk.

    Each chunk must have both variants, or the job fails; ``grams`` gives a question's grams. Similar questions of one chunk
    do not matter.
    """
    whole = rows.groupBy("chunk_id").agg(F.count_distinct("variant").alias("k"), F.count("*").alias("n"))
    chunks = require(whole, (F.col("k") == 2) & (F.col("n") == 2), "a chunk needs both variants").select(F.col("chunk_id").alias("id"))
    keyed = rows.withColumn("_id", F.struct("chunk_id", "variant"))
    pairs = near_questions(keyed, grams, "_id", threshold)
    edges = pairs.select(F.col("earlier.chunk_id").alias("a"), F.col("later.chunk_id").alias("b")).where("a <> b")  # repeats do not matter
    return graph.greedy_survivors(chunks, edges).withColumnRenamed("id", "chunk_id")


def sample_keeping_gold(docs: DataFrame, gold: DataFrame, size: int, seed: str) -> DataFrame:
    """All gold documents and distractors by keyed digest, ``size`` in all."""
    need = gold.select("doc_id").distinct()
    kept = docs.join(need, "doc_id", "left_semi")
    rest = docs.join(need, "doc_id", "left_anti").orderBy(keyed_digest(SAMPLE_SCHEMA, seed, F.col("doc_id").cast("string")))
    return kept.unionByName(rest.limit(max(0, size - need.count())))
