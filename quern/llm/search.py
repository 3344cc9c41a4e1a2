"""Ranked lexical search: postings in windows of doc_id, scattered into score arrays with an occupancy bitset, harvested into heaps."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Stages, read_table
from .ngram_join import pack, small, unpack

#: doc_ids in a window, and documents in a score array: 32 KB of scores and 512 bytes of bits.
WINDOW = 4096
#: Items and bytes of their texts whose terms make one dictionary; the documents are read once for each block of items.
ITEM_BLOCK, ITEM_BYTES = 5_000, 16 << 20
#: Postings and documents that a task gathers before it deals them out, and packed bytes of a task that scores them.
BLOCK_POSTINGS, BLOCK_DOCS, PART_BYTES = 1_000_000, 50_000, 16 << 20
#: Bytes of a text that are split into terms at a time.
SLICE = 1 << 20
#: Rows of one doc_id that a task deals to its window's own group; further ones are spread.
OWN_ROWS = 4

_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in slices: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def damping(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents of n terms, exact however large the corpus."""
    if not len(n) or 90 * int(n.max()) * docs < 1 << 62:
        return 10 + (90 * n * docs) // max(terms, 1)
    return np.array([10 + 90 * x * docs // terms for x in n.tolist()], np.int64)


class Best:
    """The k best (score, document) of one item; of equal scores the smaller doc_id, one without a doc_id last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def harvest(self, scores: np.ndarray, slots: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Takes the best of a window's occupied slots, which ascend by doc_id."""
        full = len(self.heap) == self.k
        keep = scores >= (self.heap[0][0] if full else 1)
        scores, slots = scores[keep], slots[keep]
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            above = np.flatnonzero(scores > least)
            take = np.concatenate([above, np.flatnonzero(scores == least)[: self.k - len(above)]])
            scores, slots = scores[take], slots[take]
        for s, d, missing in zip(scores.tolist(), ids[slots].tolist(), null[slots].tolist()):
            one = (s, not missing, -d)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, one)
            elif one > self.heap[0]:
                heapq.heapreplace(self.heap, one)


class WindowScorer:
    """Scores the documents of one window after the other for all items of a block."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, docs: int, terms: int, k: int):
        self.items = [t[weights[t] > 0] for t in items]
        self.weights, self.docs, self.terms = weights, docs, terms
        self.best = [Best(k) for _ in items]
        self.scores, self.bits = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 8, np.uint8)

    def window(self, blobs: list[bytes]) -> None:
        """All documents of a window, in as many arrays as it takes where doc_ids repeat."""
        ids, null, n, sizes, terms, tf = (np.concatenate(x) for x in zip(*(unpack(b) for b in blobs)))
        ids, n = ids.view(np.int64), n.astype(np.int64)
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = np.repeat(place, sizes)
        ids, null, m = ids[order], null[order], damping(n[order], self.docs, self.terms)
        by_term = np.lexsort((place, terms, place // WINDOW))
        place, terms, tf = place[by_term], terms[by_term], tf[by_term].astype(np.int64)
        gain = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
        cuts = np.searchsorted(place // WINDOW, np.arange(len(ids) // WINDOW + 2))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            at = i * WINDOW
            if a < b:
                self.scatter(place[a:b] - at, terms[a:b], gain[a:b], ids[at : at + WINDOW], null[at : at + WINDOW])

    def scatter(self, slots: np.ndarray, terms: np.ndarray, gain: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        present, starts = np.unique(terms, return_index=True)
        starts = [*starts.tolist(), len(terms)]
        occupied: dict[int, np.ndarray] = {}
        for item, best in zip(self.items, self.best):
            found = np.searchsorted(present, item)
            hits = found[(found < len(present)) & (present[np.minimum(found, len(present) - 1)] == item)].tolist()
            if not hits:
                continue
            for t in hits:
                some = slots[starts[t] : starts[t + 1]]
                self.scores[some] += gain[starts[t] : starts[t + 1]]
                if t not in occupied:
                    flags = np.zeros(WINDOW, bool)
                    flags[some] = True
                    occupied[t] = np.packbits(flags)
                self.bits |= occupied[t]
            touched = np.flatnonzero(np.unpackbits(self.bits))
            best.harvest(self.scores[touched], touched, ids, null)
            self.scores[touched] = 0
            self.bits[:] = 0


#: A blob of postings of ``n_docs`` documents, or a task's counts where win is null.
INDEX = "win long, part long, packed binary, n_docs long, n_terms long"


def indexed(docs: DataFrame, dictionary) -> DataFrame:
    """Rows of INDEX of ``docs(doc_id, text)``: packed postings of the dictionary's terms by window of doc_id, dealt to parts.

    Each task adds a row without window: its number of documents with terms, of their terms, and packed document
    frequencies. ``dictionary`` is a broadcast of {term: number}.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        number = dictionary.value.get
        df, n_docs, n_terms, task, flushes = np.zeros(len(dictionary.value), np.int64), 0, 0, TaskContext.get().partitionId(), 0
        ids, lengths, terms, counts, held = [], [], [], [], 0

        def rows(some: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in some], t) for i, t in enumerate(kinds)], ["win", "part", "packed", "n_docs", "n_terms"]
            )

        def flush() -> pa.RecordBatch:
            null = np.array([i is None for i in ids], np.uint8)
            own = np.array([i or 0 for i in ids], np.int64)
            n, sizes = np.array(lengths, np.uint64), np.array([len(t) for t in terms])
            order = np.lexsort((own, null))
            first = np.ones(len(own), bool)
            first[1:] = (own[order][1:] != own[order][:-1]) | (null[order][1:] != null[order][:-1])
            again = (np.arange(len(own)) - np.flatnonzero(first)[np.cumsum(first) - 1]) // OWN_ROWS
            win = own[order] // WINDOW
            by = np.lexsort((again, win))
            order, win, again = order[by], win[by], again[by]
            starts = np.flatnonzero(np.append(True, (win[1:] != win[:-1]) | (again[1:] != again[:-1])))
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(win)]):
                at = order[a:b]
                part = xxh64_intdigest(f"{task} {flushes} {again[a]}") >> 1 if again[a] else 0
                out.append((int(win[a]), part, pack(
                    own[at].view(np.uint64), null[at], small(n[at]), small(sizes[at]),
                    small(np.concatenate([terms[i] for i in at])), small(np.concatenate([counts[i] for i in at])),
                ), b - a, None))
            return rows(out)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, known = 0, []
                for some in terms_of(text.as_py() or ""):
                    n += len(some)
                    known.append([x for x in map(number, some) if x is not None])
                if not n:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + n
                t, c = np.unique(np.concatenate([np.array(x, np.int64) for x in known]), return_counts=True)
                if not len(t):
                    continue
                df[t] += 1
                ids.append(doc)
                lengths.append(n)
                terms.append(t)
                counts.append(c)
                held += len(t)
                if held >= BLOCK_POSTINGS or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    ids, lengths, terms, counts, held, flushes = [], [], [], [], 0, flushes + 1
        if ids:
            yield flush()
        there = np.flatnonzero(df)
        yield rows([(None, None, pack(there.astype(np.uint64), df[there].view(np.uint64)), n_docs, n_terms)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df) from the rows without window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                t, df = unpack(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(df.view(np.int64))], ["term", "df"])

    parts = index.where("win is null").select("packed").mapInArrow(run, "term long, df long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def _search_block(stages: Stages, docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ranking for the items ``(item_id, terms)`` of one block."""
    spark = docs.sparkSession
    listed = items.collect()
    names = {t: i for i, t in enumerate(sorted({bytes(t) for r in listed for t in r["terms"]}))}
    of = [np.array(sorted(names[bytes(t)] for t in r["terms"]), np.int64) for r in listed]
    index = stages.table(indexed(docs, spark.sparkContext.broadcast(names)))
    whole = F.col("win").isNull()
    n, total, size = index.agg(F.sum(F.when(whole, F.col("n_docs"))), F.sum("n_terms"), F.sum(F.octet_length("packed"))).first()
    weights = np.zeros(len(names), np.int64)
    for t, df in frequencies(index).collect():
        weights[t] = weight(df, n)
    sent = spark.sparkContext.broadcast((of, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WindowScorer(*sent.value, n, total, k)
        key, blobs, held = None, [], 0
        for batch in batches:
            for w, p, packed, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (w, p) != key and 2 * held >= WINDOW:  # thinly filled windows share an array
                    scorer.window(blobs)
                    blobs, held = [], 0
                key = (w, p)
                blobs.append(packed)
                held += size
        if blobs:
            scorer.window(blobs)
        out = [(i, None if not there else -d, s) for i, b in enumerate(scorer.best) for s, there, d in b.heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["item", "doc_id", "score"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PART_BYTES))
    dealt = index.where("win is not null").select("win", "part", "packed", "n_docs").repartition(parts, "win", "part").sortWithinPartitions("win", "part")
    found = dealt.mapInArrow(score, "item long, doc_id long, score long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    kind = items.schema["item_id"].dataType.simpleString()
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(listed)], f"item long, item_id {kind}")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k documents of ``docs(doc_id, text)`` with the highest score above 0 for each item of ``items(item_id, text)``.

    Returns item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id. A document's score sums, over the
    item's different terms, weight(df, N) * (10^9 tf div (1000 tf + 8 m)), m its damping; all but the weight's logarithm is
    whole arithmetic, so the ranking does not depend on how rows are dealt.

    Items go in blocks of bounded size, whose terms make a broadcast dictionary. One pass over the texts cuts the postings
    of these terms and counts N, L and df over all documents; postings are dealt by windows of WINDOW doc_ids. A task
    traverses its windows, scatters every term's gains into a score array, marks the slots in a bitset, and harvests the
    marked slots into a heap per item; the heaps of all tasks are merged by rank.

    Null and empty texts, and texts without terms, take no part and do not count in N. Rows are documents of their own, also
    if they share a doc_id (the rows of a doc_id that repeats are spread over tasks); a document without doc_id ranks after
    others of its score. Rows with one item_id are one item with the terms of all; a null item_id is one too. An item
    without terms has no rows, and neither has one whose terms no document holds. Texts of any length are read whole, in
    slices. Empty tables give no rows. Other columns are not read.
    """
    spark, stages = docs.sparkSession, Stages(docs.sparkSession, "search")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t for some in terms_of(x.as_py() or "") for t in some}) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    given = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = given.schema["item_id"].dataType.simpleString()
    rows = given.mapInArrow(cut, f"item_id {kind}, terms array<binary>").select("item_id", F.explode_outer("terms").alias("term"))
    whole = stages.table(rows.distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms")))
    many, size = whole.agg(F.count("*"), F.sum(F.size("terms") * 16)).first()
    blocks = max(-(-many // ITEM_BLOCK), -(-(size or 0) // ITEM_BYTES), 1)
    block = F.pmod(F.xxhash64(F.struct("item_id")), F.lit(blocks))
    return reduce(DataFrame.union, [_search_block(stages, docs, whole.where(block == i), k) for i in range(blocks)])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10)


_TERMS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP11_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS_SQL} AS g FROM documents WHERE text IS NOT NULL),
d AS (SELECT id, doc_id, len(g) AS n FROM t WHERE len(g) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT id, unnest(g) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY 1),
m AS (SELECT id, doc_id, 10 + (90 * CAST(n AS BIGINT) * docs) // terms AS m FROM d, c),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (id) GROUP BY item_id, id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
