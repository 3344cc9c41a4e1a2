"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Stages, components, read_table

WORDS = 5
#: A pair links when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: Shingles a task gathers before it deals them out, and input bytes per group of the frequency count.
BLOCK_SHINGLES, GROUP_BYTES = 2_000_000, 8 << 20
#: Spark's estimate for a plan whose size it does not know is above this; the texts are then measured.
UNKNOWN_SIZE = 1 << 50
#: Words kept in a worker's cache of word hashes; it is emptied when full.
CACHE_WORDS = 500_000
#: Ranges of hashes in which the suffix filter counts a set's remaining shingles.
SUFFIX_BINS = 8

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int = WORDS):
        from xxhash import xxh64_intdigest

        class Cache(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[word] = out = xxh64_intdigest(word)
                return out

        self.words, self.hash, self.cache = words, xxh64_intdigest, Cache()

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(words) < self.words:
            return np.array([self.hash(b" ".join(words), 1)] if words else [], np.uint64)
        one = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        n = len(one) - self.words + 1
        out = one[:n].copy()
        for k in range(1, self.words):
            out *= _MULTIPLIER
            out += one[k : k + n]
        out ^= out >> np.uint64(29)
        out *= _MULTIPLIER
        out ^= out >> np.uint64(32)
        return np.unique(out)


def needed(n):
    """Shingles that a set of n must share with any set it links to."""
    return -(-NUM * n // DEN)


# Packed rows: several numpy arrays in one binary value. Planes of bytes compress well when values are sorted.
def pack(*arrays: np.ndarray) -> bytes:
    head = [len(arrays)]
    body = []
    for a in arrays:
        head += [a.itemsize, len(a)]
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return np.array(head, "<u4").tobytes() + b"".join(body)


def unpack(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, "<u4", 2 * count, 4).tolist()
    at, out = 4 + 8 * count, []
    for size, n in zip(head[::2], head[1::2]):
        planes = np.frombuffer(data, np.uint8, size * n, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel())
        at += size * n
    return out


def small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def batch_of(key: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], [key, "packed"]
    )


def deal(hashes: list[np.ndarray], sets: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Deals the shingles of a block of sets to groups by ranges of the hash: (group, packed sorted hashes and sets)."""
    of = np.repeat(np.arange(len(hashes), dtype=np.uint32), [len(h) for h in hashes])
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(flat)
    flat, of = flat[order], of[order]
    group = ((flat >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    cuts = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
    for g in range(groups):
        a, b = cuts[g], cuts[g + 1]
        if a < b:
            here, place = np.unique(of[a:b], return_inverse=True)
            steps = np.diff(flat[a:b], prepend=np.uint64(0))
            yield g, pack(steps, small(place), sets[here, 0], small(sets[here, 1]))


def shared(blobs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, set, size of the set, sets with the hash) for hashes in two sets or more."""
    parts = [unpack(x) for x in blobs]
    h = np.concatenate([np.cumsum(p[0]) for p in parts])
    s = np.concatenate([p[2][p[1]] for p in parts])
    n = np.concatenate([p[3][p[1]].astype(np.uint32) for p in parts])
    order = np.argsort(h)
    h, s, n = h[order], s[order], n[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    keep = np.zeros(len(h), bool)
    keep[same] = keep[same + 1] = True
    h, s, n = h[keep], s[keep], n[keep]
    order = np.lexsort((s, h))
    h, s, n = h[order], s[order], n[order]
    first = np.ones(len(h), bool)  # a set that several tasks met counts once
    first[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    h, s, n = h[first], s[first], n[first]
    if not len(h):
        return h, s, n, n
    _, place, count = np.unique(h, return_inverse=True, return_counts=True)
    df = count[place].astype(np.uint32)
    keep = df > 1
    return h[keep], s[keep], n[keep], df[keep]


SETS = "set_id long, n int, shared binary"


def set_rows(blobs: Iterator[bytes]) -> pa.RecordBatch:
    """Rows of SETS with shared shingles rare-first, for sets whose prefix holds a shared shingle; no other set can link."""
    parts = [unpack(x) for x in blobs]
    place = [np.repeat(np.arange(len(p[0])), p[2]) for p in parts]
    s = np.concatenate([p[0][i] for p, i in zip(parts, place)])
    n = np.concatenate([p[1][i].astype(np.int64) for p, i in zip(parts, place)])
    h = np.concatenate([p[3] for p in parts])
    df = np.concatenate([p[4].astype(np.uint32) for p in parts])
    order = np.lexsort((h, df, s))
    s, n, h = s[order], n[order], h[order]
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, int)
    ends = np.append(starts[1:], len(s))
    ids, sizes, lists = [], [], []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if needed(int(n[a])) <= b - a:  # the prefix is n - needed + 1 long, n - shared of it in this set alone
            ids.append(s[a])
            sizes.append(n[a])
            lists.append(h[a:b].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(lists, pa.binary())],
        ["set_id", "n", "shared"],
    )


def shingle_sets(stages: Stages, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members(doc_id, n, set_id), sets(SETS)): documents with equal shingle sets share a set id, a hash of the set.

    One pass over the texts deals packed sorted hashes to groups by hash range, which find each hash's number of
    sets; hashes in two sets or more go on to groups by set. Neither a text nor an unshared hash travels further.
    """
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_SIZE:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, size // GROUP_BYTES)
    set_groups = max(least, groups // 4)
    words = WORDS

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        shingler, seen, known = Shingler(words), {}, set()
        ids, members, hashes, sets, total = [], [], [], [], 0

        def flush():
            table = np.array(sets, np.uint64).reshape(-1, 2)
            for g, packed in deal(hashes, table, groups):
                yield batch_of("g", [(g, packed)])
            rows = np.array(members, np.uint64).reshape(-1, 2)
            null = np.array([i is None for i in ids], np.uint8)
            own = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
            yield batch_of("g", [(-1 - (xxh64_intdigest(own.tobytes()) % (1 << 20)), pack(own, null, rows[:, 0], rows[:, 1]))])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                key = xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                if key not in seen:
                    h = shingler(text)
                    seen[key] = one = (xxh64_intdigest(h.tobytes(), len(h)), len(h))
                    if len(h) and one[0] not in known:
                        known.add(one[0])
                        hashes.append(h)
                        sets.append(one)
                        total += len(h)
                ids.append(doc)
                members.append(seen[key])
                if total >= BLOCK_SHINGLES or len(ids) >= 50_000:
                    yield from flush()
                    ids, members, hashes, sets, total = [], [], [], [], 0
        if ids:
            yield from flush()

    def frequency(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        if g < 0:
            return table.select(["g", "packed"])
        h, s, n, df = shared(x.as_py() for x in table.column("packed"))
        group = s % np.uint64(set_groups)
        order = np.lexsort((h, s, group))
        h, s, n, df, group = h[order], s[order], n[order], df[order], group[order]
        cuts = np.searchsorted(group, np.arange(set_groups + 1, dtype=np.uint64))
        rows = []
        for q in range(set_groups):
            a, b = cuts[q], cuts[q + 1]
            if a < b:
                ids, first, count = np.unique(s[a:b], return_index=True, return_counts=True)
                rows.append((q, pack(ids, small(n[a:b][first]), small(count), h[a:b], small(df[a:b]))))
        return pa.Table.from_batches([batch_of("g", rows)])

    def collect_sets(table: pa.Table) -> pa.Table:
        if table.column("g")[0].as_py() < 0:
            packed = table.column("packed").combine_chunks()
            none = pa.nulls(len(packed))
            return pa.table({"set_id": none.cast(pa.int64()), "n": none.cast(pa.int32()), "shared": none.cast(pa.binary()), "members": packed})
        rows = set_rows(x.as_py() for x in table.column("packed"))
        return pa.Table.from_batches([rows]).append_column("members", pa.nulls(rows.num_rows, pa.binary()))

    packed = "g long, packed binary"
    both = stages.table(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(shingle, packed)
        .groupBy("g").applyInArrow(frequency, packed)
        .groupBy("g").applyInArrow(collect_sets, f"{SETS}, members binary")
    )

    def unpack_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                ids, null, sets, n = unpack(x.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64), mask=null.astype(bool)), pa.array(n.astype(np.int32)), pa.array(sets.view(np.int64))],
                    ["doc_id", "n", "set_id"],
                )

    members = both.where("members is not null").select("members").mapInArrow(unpack_members, "doc_id long, n int, set_id long")
    return members, both.where("members is null").drop("members")


POSTING = "h long, set_id long, n int, rare int, place int, tail array<int>"


def postings(sets: DataFrame) -> DataFrame:
    """Rows of POSTING for the shared shingles of each set's prefix, with counts by range of the shingles behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out: list[list] = [[] for _ in range(6)]
                for s, n, data in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    h = np.frombuffer(data, np.uint64)
                    rare = n - len(h)
                    k = n - needed(n) + 1 - rare
                    bins = (h >> np.uint64(61)).astype(int)
                    behind = np.eye(SUFFIX_BINS, dtype=np.int32)[bins[::-1]].cumsum(0)[::-1]
                    tail = np.zeros((k, SUFFIX_BINS), np.int32)
                    tail[: len(h) - 1] = behind[1 : k + 1]
                    out[0].append(h[:k].view(np.int64))
                    for j, v in ((1, s), (2, n), (3, rare)):
                        out[j].append(np.full(k, v))
                    out[4].append(np.arange(rare, rare + k))
                    out[5].append(tail)
                flat = [np.concatenate(x) for x in out]
                tails = pa.ListArray.from_arrays(np.arange(0, len(flat[0]) * SUFFIX_BINS + 1, SUFFIX_BINS, dtype=np.int32), flat[5].ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[0]), pa.array(flat[1], pa.int64()), *[pa.array(flat[j].astype(np.int32)) for j in (2, 3, 4)], tails],
                    ["h", "set_id", "n", "rare", "place", "tail"],
                )

    return sets.select("set_id", "n", "shared").mapInArrow(run, POSTING)


def may_link(a: str, b: str):
    """Length, positional and suffix filters for two postings of one shingle; true for every pair that links and
    has no earlier common shingle."""
    ca, cb = (lambda x: F.col(f"{a}.{x}")), (lambda x: F.col(f"{b}.{x}"))
    least = F.lit(NUM) * (ca("n") + cb("n"))
    length = DEN * F.least(ca("n"), cb("n")) >= NUM * F.greatest(ca("n"), cb("n"))
    behind = F.least(ca("n") - ca("place"), cb("n") - cb("place"))
    suffix = F.lit(1)
    for i in range(SUFFIX_BINS):
        suffix = suffix + F.least(ca("tail")[i], cb("tail")[i])
    return length & ((DEN + NUM) * behind >= least) & ((DEN + NUM) * suffix >= least)


def verify(pairs: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose sets link; each pair's shared shingles meet once."""
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = zip(batch.column("s_a"), batch.column("s_b"))  # read where they lie: a batch holds thousands of whole sets
            for a, b, na, nb, (sa, sb) in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "n_a", "n_b")), lists):
                common = len(np.intersect1d(np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64), assume_unique=True))
                if den * common >= num * (na + nb - common):
                    rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


def set_components(stages: Stages, sets: DataFrame) -> DataFrame:
    """(id, component) of the sets that link with another one.

    Each prefix shingle's sets are first verified against one of them, the one with the fewest shingles of its own
    (a group of near copies becomes a star, not all its pairs). Then every pair that shares a prefix shingle, passes
    the filters and lies in different components is verified too, so that no link between components is lost.
    """
    lists = postings(sets)
    grid = stages.table(lists)
    centre = (
        grid.groupBy("h").agg(F.min(F.struct("rare", "set_id", "n")).alias("c"), F.count("*").alias("k")).where("k > 1")
        .select("h", F.col("c.set_id").alias("centre"), F.col("c.n").alias("n_c"))
    )
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = stages.table(
        grid.join(centre, "h").where(
            (F.col("set_id") != F.col("centre")) & (DEN * F.least("n", "n_c") >= NUM * F.greatest("n", "n_c"))
        ).select(*pair(F.col("set_id"), F.col("centre"))).distinct()
    )
    edges = stages.table(verify(stars, sets))
    label = components(stages, edges).withColumnRenamed("id", "set_id")
    marked = grid.join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = marked.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    rest = stages.table(marked.join(mixed, "h"))
    cross = (
        rest.alias("x").join(rest.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.component") < F.col("y.component")) & may_link("x", "y"))
        .select(*pair(F.col("x.set_id"), F.col("y.set_id"))).distinct().join(stars, ["a", "b"], "left_anti")
    )
    more = stages.table(verify(cross, sets))
    out = components(stages, edges.union(more))
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, set_id.

    Words are maximal runs without white space of ASCII, A-Z lower-cased; a document's set is its distinct five-word
    shingles, or its whole sequence of fewer words. Documents with equal sets link; different sets link when their
    Jaccard similarity is at least NUM / DEN. component_id is the smallest doc_id reachable by links.

    Shingles and sets are 64-bit hashes (at 10^10 different sets a handful may share an id). Null text and text
    without words: no shingles, linked with nothing. A null doc_id takes part and is never a component's name unless
    it is alone. Repeated rows give repeated results; an empty table gives none; other columns are not read.
    """
    stages = Stages(docs.sparkSession, "ngram_join")
    members, sets = shingle_sets(stages, docs)
    label = set_components(stages, sets).withColumnRenamed("id", "set_id")
    placed = members.where("n > 0").join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(names, "component").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "set_id")
    alone = members.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "set_id")
    return linked.unionByName(alone)


#: Row keys that may be broadcast to take rows out (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component stays, that with the smallest hash of its columns.

    Rows are known by a 64-bit hash of all their columns (maps left out), which any later reading of ``docs`` finds
    again. Rows equal in all columns are one group too: one of them stays, if they have words. Null and empty text and
    text without words: the row stays. Ties cannot occur. An empty table gives no rows. Columns keep their names and
    values, whatever they are.
    """
    stages = Stages(docs.sparkSession, "ngram_keep")
    hashed = [F.col(f.name) for f in docs.schema.fields if f.dataType.typeName() != "map"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(*hashed).alias("key"), F.col("text").cast("string").alias("words"))
    same = jaccard_components(rows.select(F.col("key").alias("doc_id"), F.col("words").alias("text")))
    groups = stages.table(
        same.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n"), F.min("component_id").alias("first"))
        .where("n > 1 or key <> first")
    )
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    gone, twice = groups.where("key <> first").select("key"), groups.where("key = first").select("key")
    rows = rows.select("row", "key")
    once = rows.join(few(groups.select("key")), "key", "left_anti")
    if twice.isEmpty():
        return rows.join(few(gone), "key", "left_anti").select("row.*")
    return once.select("row.*").union(rows.join(few(twice), "key", "left_semi").dropDuplicates(["key"]).select("row.*"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                      WHEN len(w) > 0 THEN [chr(1) || array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, b.y FROM r JOIN b ON r.m = b.x)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT d, min(m) AS m FROM r GROUP BY 1) t ON t.d = documents.doc_id
"""
