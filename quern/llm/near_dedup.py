"""MinHash near-dedup: multi-index Hamming join of b-bit signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Stages, arrow_rows, components, read_table
from .line_dedup import agreeing, pair
from .ngram_join import Shingler, pack, shared, small, unpack, verify

WORDS = 4
#: A pair links when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: A signature has CHUNKS chunks of CELLS cells; a cell holds 8 bits of a minimum. Of two signatures at a distance of at most
#: LIMIT cells one chunk or more differs in one cell at most (pigeonhole: two cells in every chunk would be LIMIT + 1), so
#: that they share a key of it: the chunk without one of its cells. At similarity 0.8 the distance is 28.8 on average with
#: a deviation of 4.8, and fewer than 1 pair in 10,000 is beyond LIMIT; at 0.85 none in 10 million.
CHUNKS, CELLS = 24, 6
LIMIT, CELLS_ALL = 2 * CHUNKS - 1, CHUNKS * CELLS
#: Shingles hashed at a time, sets whose keys a task gathers before it deals them out, and key bytes in a group.
SLICE, BLOCK_SETS, GROUP_BYTES = 4096, 10_000, 8 << 20
#: Sets of one key that a block deals to the key's group, two at least, which tell the group that the key is shared; further ones go on
#: their own.
OWN_SETS = 4
#: Rounds in which a set is verified with its nearest one in another component before all remaining pairs are; sets of a key
#: compared in one block; rows of a group whose pairs are compared together with those of other groups.
NEAREST_ROUNDS, BLOCK, SMALL = 2, 1024, 8
#: Rows with a whole text or whole sets that a worker gets at a time.
WIDE_ROWS = 500
#: Rows of two numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bits in the parity of a set: the least power of two that is twice its size or more, within these.
PARITY_BITS = 64, 8192

_SIGNS = [f"s{i}" for i in range(CELLS_ALL // 8)]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def signature(hashes: np.ndarray) -> np.ndarray:
    """CELLS_ALL bytes: 8 bits of the least product of the hashes with each of as many odd numbers."""
    factors = (_mixed(np.arange(1, CELLS_ALL + 1, dtype=np.uint64) * _ODD) | np.uint64(1))[:, None]
    least = np.full(CELLS_ALL, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), SLICE):
        least = np.minimum(least, (factors * hashes[None, at : at + SLICE]).min(1))
    return (_mixed(least) >> np.uint64(56)).astype(np.uint8)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """The CELLS_ALL keys of each signature: every chunk without each of its cells."""
    cells = signatures.reshape(len(signatures), CHUNKS, CELLS).astype(np.uint64)
    whole = (cells << (np.arange(CELLS, dtype=np.uint64) * np.uint64(8))).sum(2, dtype=np.uint64)
    drop = np.arange(CELLS, dtype=np.uint64)
    left = whole[:, :, None] & ~(np.uint64(255) << drop * np.uint64(8))
    chunk = np.arange(CHUNKS, dtype=np.uint64)[:, None]
    return _mixed(left + (drop << np.uint64(48)) + (chunk << np.uint64(52))).reshape(len(signatures), CELLS_ALL)


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first key that two signatures in the rows of ``a`` and ``b`` share; they must be within LIMIT."""
    differ = (a != b).reshape(len(a), CHUNKS, CELLS)
    chunk = (differ.sum(2) <= 1).argmax(1)
    place = chunk * CELLS + differ[np.arange(len(a)), chunk].argmax(1)
    return chunk_keys(a)[np.arange(len(a)), place]


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each remainder of a hash, one if an odd number of the set's different hashes have it."""
    least, most = PARITY_BITS
    bits = min(max(1 << (2 * len(hashes) - 1).bit_length(), least), most)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """The parities of some sets, those of equal length in one array."""

    def __init__(self, parities: np.ndarray):
        self.words = np.array([len(p) // 8 for p in parities])
        self.place = np.zeros(len(parities), int)
        self.arrays = {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.place[own] = np.arange(len(own))
            self.arrays[w] = np.frombuffer(b"".join(parities[own]), "<u8").reshape(-1, w)

    def folded(self, rows: np.ndarray, words: int) -> np.ndarray:
        """The parities of ``rows`` for as many bits as fit into ``words``: both halves of a longer one fall on the same bits."""
        out = np.empty((len(rows), words), np.uint64)
        for w in np.unique(self.words[rows]).tolist():
            own = self.words[rows] == w
            some = self.arrays[w][self.place[rows[own]]]
            while some.shape[1] > words:
                some = some[:, : some.shape[1] // 2] ^ some[:, some.shape[1] // 2 :]
            out[own] = some
        return out

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which rows ``x`` and ``y`` differ; each takes a shingle that one of the two sets alone has."""
        least, out = np.minimum(self.words[x], self.words[y]), np.zeros(len(x), int)
        for w in np.unique(least).tolist():
            own = np.flatnonzero(least == w)
            for at in range(0, len(own), 8192):
                some = own[at : at + 8192]
                out[some] = np.bitwise_count(self.folded(x[some], w) ^ self.folded(y[some], w)).sum(1)
        return out


def parities_allow(differing: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """True for every pair that links: of a pair's ``sizes``, added up, at most (DEN - NUM) / (DEN + NUM) are in one set alone."""
    return (DEN + NUM) * differing <= (DEN - NUM) * sizes


def distance(a: str, b: str) -> Column:
    return CELLS_ALL - agreeing(a, b, _SIGNS, CELLS_ALL)


def may_link(a: str, b: str) -> Column:
    """Sizes that allow a link, and signatures within LIMIT."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)) & (distance(a, b) <= LIMIT)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, n, s0, ...) per document; the signature stands with a set's first document in a task only."""
    words = WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        shingler, texts, known = Shingler(words), {}, set()
        for batch in batches:
            sets, signs = [], np.zeros((batch.num_rows, CELLS_ALL), np.uint8)
            first = np.zeros(batch.num_rows, bool)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                key = xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                if key not in texts:
                    h = shingler(text)
                    texts[key] = one = (xxh64_intdigest(h.tobytes(), len(h)), len(h))
                    if len(h) and one[0] not in known:
                        known.add(one[0])
                        signs[i], first[i] = signature(h), True
                sets.append(texts[key])
            ids = np.array([s for s, _ in sets], np.uint64).view(np.int64)
            cells = signs.view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids), pa.array([n for _, n in sets], pa.int64())]
                + [pa.array(cells[:, j], mask=~first) for j in range(len(_SIGNS))],
                ["doc_id", "set_id", "n", *_SIGNS],
            )

    schema = "doc_id long, set_id long, n long, " + ", ".join(f"{s} long" for s in _SIGNS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def shared_keys(stages: Stages, sets: DataFrame) -> DataFrame:
    """(band, id): the keys that two sets or more of ``sets(id, s0, ...)`` have, each with all its sets.

    Keys are dealt packed and sorted to groups by range, which find those of several sets. A key that a block of sets
    has more than OWN_SETS times is known to be shared: its further sets do not go to the group.
    """
    least = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, sets.count() * CELLS_ALL * 12 // GROUP_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([i for i, _ in held])
            keys = chunk_keys(np.concatenate([s for _, s in held])).ravel()
            of = np.repeat(np.arange(len(ids)), CELLS_ALL)
            order = np.argsort(keys, kind="stable")
            keys, of = keys[order], of[order]
            first = np.append(True, keys[1:] != keys[:-1])
            place = np.arange(len(keys)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            more = place >= OWN_SETS
            if more.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(int(more.sum()), pa.int64()), pa.nulls(int(more.sum()), pa.binary()),
                     pa.array(keys[more].view(np.int64)), pa.array(ids[of[more]].view(np.int64))], ["g", "packed", "band", "id"],
                )
            keys, of = keys[~more], of[~more]
            group = ((keys >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            cuts = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
            rows = []
            for g in np.flatnonzero(np.diff(cuts)).tolist():
                some = slice(cuts[g], cuts[g + 1])
                here, at = np.unique(of[some], return_inverse=True)
                rows.append((g, pack(np.diff(keys[some], prepend=np.uint64(0)), small(at), ids[here], np.ones(len(here), "<u1"))))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary()), none, none], ["g", "packed", "band", "id"]
            )

        for batch in batches:
            cells = np.stack([batch.column(j + 1).to_numpy(zero_copy_only=False) for j in range(len(_SIGNS))], 1)
            held.append((batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), np.ascontiguousarray(cells).view(np.uint8)))
            if sum(len(i) for i, _ in held) >= BLOCK_SETS:
                yield from flush()
                held = []
        if sum(len(i) for i, _ in held):
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        h, s, _, _ = shared(x.as_py() for x in table.column("packed"))
        return pa.table({"band": pa.array(h.view(np.int64)), "id": pa.array(s.view(np.int64))})

    dealt = stages.table(sets.select("id", *_SIGNS).mapInArrow(deal, "g long, packed binary, band long, id long"))
    met = dealt.where("g is not null").select("g", "packed").groupBy("g").applyInArrow(meet, "band long, id long")
    out = stages.table(met.union(dealt.where("g is null").select("band", "id")))
    stages.drop(dealt)
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, n, shared, parity): all shingle hashes of the sets ``wanted(set_id)``, from one more reading of the texts."""
    words = WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        shingler, known = Shingler(words), set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                h = shingler(text.as_py() or "")
                one = xxh64_intdigest(h.tobytes(), len(h))
                if len(h) and one not in known:
                    known.add(one)
                    rows.append((one, len(h), h.tobytes(), parity(h)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary()),
            ], ["set_id", "n", "shared", "parity"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "set_id long, n long, shared binary, parity binary")
    return found.join(few(wanted), "set_id", "left_semi").dropDuplicates(["set_id"])


def few(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def star_pairs(members: DataFrame) -> DataFrame:
    """Different (a, b): each set of ``members(band, id, degree)`` with two centres of its keys at most, the one that is so for
    most of its keys and the one with the highest degree. The centre of a key is its set with the highest degree."""
    centre = members.groupBy("band").agg(F.max(F.struct("degree", "id")).alias("c"))
    met = members.join(centre, "band").where(F.col("id") != F.col("c.id"))
    met = met.groupBy("id", F.col("c.id").alias("centre")).agg(F.count("*").alias("k"), F.max("c.degree").alias("d"))
    best = met.groupBy("id").agg(F.max(F.struct("k", "d", "centre")).alias("x"), F.max(F.struct("d", "k", "centre")).alias("y"))
    return best.select("id", F.explode(F.array("x.centre", "y.centre")).alias("centre")).select(*pair(F.col("id"), F.col("centre"))).distinct()


def nearest_only(found: np.ndarray) -> np.ndarray:
    """The rows of ``found(a, b, distance)`` that are the nearest of their a or of their b."""
    keep = np.zeros(len(found), bool)
    for side in (0, 1):
        order = np.lexsort((found[:, 1 - side], found[:, 2], found[:, side]))
        keep[order[np.append(True, found[order][1:, side] != found[order][:-1, side])]] = True
    return found[keep]


def compare(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, d) of rows ``(band, i, j, block, id, component, n, parity, s0, ...)`` sorted by band, i and j: sets of block i with those
    of block j that lie in different components, may link by their sizes and parities and are within LIMIT; each pair under its
    first key only.
    ``nearest``: of each set's pairs in a group of more than SMALL rows the nearest one.

    The pairs of all small groups of a batch are compared at once, those of a larger group 64 sets at a time.
    """
    names = ("band", "i", "j", "block", "id", "component", "n", "parity")

    def near(rows: dict, odd: Parities, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        small, large = np.minimum(rows["n"][p], rows["n"][q]), np.maximum(rows["n"][p], rows["n"][q])
        may = np.flatnonzero((rows["component"][p] != rows["component"][q]) & (DEN * small >= NUM * large))
        out = []
        for at in range(0, len(may), 65_536):
            x, y = p[may[at : at + 65_536]], q[may[at : at + 65_536]]
            d = (rows["cells"][x] != rows["cells"][y]).sum(1)
            x, y, d = x[d <= LIMIT], y[d <= LIMIT], d[d <= LIMIT]
            if len(x):
                first = first_key(rows["cells"][x], rows["cells"][y]).view(np.int64) == rows["band"][x]
                x, y, d = x[first], y[first], d[first]
                let = parities_allow(odd.differing(x, y), rows["n"][x] + rows["n"][y])
                one, two = rows["id"][x[let]], rows["id"][y[let]]
                out.append(np.stack([np.minimum(one, two), np.maximum(one, two), d[let]], 1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def groups(rows: dict, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        sizes, odd = ends - starts, Parities(rows["parity"])
        for size in range(2, SMALL + 1):
            some = starts[sizes == size][:, None]
            x, y = np.triu_indices(size, 1)
            yield near(rows, odd, (some + x).ravel(), (some + y).ravel())
        for at, end in zip(starts[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist()):
            i, j, block = rows["i"][at], rows["j"][at], rows["block"][at:end]
            left, right = np.flatnonzero(block == i) + at, np.flatnonzero(block == j) + at
            found = []
            for k in range(0, len(left), 64):
                some = left[k : k + 64]
                x, y = np.nonzero(some[:, None] < right[None] if i == j else np.ones((len(some), len(right)), bool))
                found.append(near(rows, odd, some[x], right[y]))
            both = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            yield nearest_only(both) if nearest and len(both) else both

    def result(parts: Iterator[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate([np.zeros((0, 3), np.int64), *parts])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k]), pa.int64()) for k in range(3)], ["a", "b", "d"])

    held: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
        cells = np.stack([batch.column(len(names) + k).to_numpy(zero_copy_only=False) for k in range(len(_SIGNS))], 1)
        rows["cells"] = np.ascontiguousarray(cells).view(np.uint8).reshape(batch.num_rows, CELLS_ALL)
        rows = {c: np.concatenate([held[c], rows[c]]) for c in rows} if held else rows
        new = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("band", "i", "j")])
        starts = np.flatnonzero(np.append(True, new))
        yield result(groups(rows, starts[:-1], starts[1:]))
        held = {c: v[starts[-1] :] for c, v in rows.items()}  # the last group may go on
    if held:
        yield result(groups(held, np.array([0]), np.array([len(held["id"])])))


def crossing(members: DataFrame, label: DataFrame, signs: DataFrame, nearest: bool) -> DataFrame:
    """Different (a, b, d) of sets that share a key, lie in different components and may link, from ``members(band, id)``; with
    ``nearest`` each set's nearest one in a group only.

    The sets of a key are dealt into blocks of BLOCK, and each pair of blocks is compared on its own; only pairs that may
    link leave a task.
    """
    marked = members.join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    mixed = marked.groupBy("band").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo < hi").select("band", "blocks")
    rest = marked.join(mixed, "band").withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component")
    dealt = rest.join(signs, "id").select("band", "i", "j", "block", "id", "component", "n", "parity", *_SIGNS)
    run = lambda batches: compare(batches, nearest)
    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long, d long")


def set_links(stages: Stages, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, component) of the sets that link with another one, of ``sets(id, n, s0, ...)``.

    The sets of a key have one of them as their centre, the one with most neighbours. A set is compared with two of its
    centres and verified with the nearer one. In the next rounds the sets of a key that lie in different components are compared
    with each other, and each is verified with the nearest. At last every pair of a key is verified whose sets lie in different
    components, whose signatures are within LIMIT and whose parities allow a link.
    """
    keyed = shared_keys(stages, sets)
    crowd = keyed.groupBy("band").agg(F.count("*").alias("k"))
    degree = keyed.join(crowd, "band").groupBy("id").agg(F.sum("k").alias("degree"))
    members = stages.table(keyed.join(degree, "id"))
    stages.drop(keyed)
    nodes = stages.table(members.select("id").distinct())
    with arrow_rows(stages.spark, WIDE_ROWS):
        full = stages.table(whole_sets(docs, nodes.withColumnRenamed("id", "set_id")))
    signs = stages.table(sets.join(full.select(F.col("set_id").alias("id"), "parity"), "id"))
    stages.drop(nodes)

    def near(pairs: DataFrame) -> DataFrame:
        side = lambda x: signs.select(F.col("id").alias(x), "n", *_SIGNS).alias(x)
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        return met.where(may_link("a", "b")).select("a", "b", distance("a", "b").alias("d"))

    def linked(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
        with arrow_rows(stages.spark, WIDE_ROWS):
            edges = stages.table(verify(pairs, full, NUM, DEN))
        known = label.select(F.col("id").alias("a"), F.col("component").alias("b")) if label is not None else None
        return components(stages, edges.union(known) if known is not None else edges)

    def best(met: DataFrame) -> DataFrame:
        """The nearest pair of each set in ``met(a, b, d)``."""
        ends = met.select("a", "b", "d", F.explode(F.array("a", "b")).alias("id"))
        return stages.table(ends.groupBy("id").agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b").distinct())

    met = stages.table(near(star_pairs(members)))
    label = linked(best(met), None)
    stages.drop(met)
    keys = members.select("band", "id")
    for _ in range(NEAREST_ROUNDS):
        met = stages.table(crossing(keys, label, signs, True))
        if met.isEmpty():
            break
        label = linked(best(met), label)
        stages.drop(met)
    cross = stages.table(crossing(keys, label, signs, False))
    out = label if cross.isEmpty() else linked(cross.select("a", "b"), label)
    stages.drop(members, signs, full, cross)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without ASCII white space, A-Z lower-cased; a document's set is its distinct four-word shingles,
    or its whole sequence of fewer words. Documents with equal sets link; different sets link when their Jaccard similarity
    is at least NUM / DEN, confirmed on the full sets. Candidates are all pairs whose MinHash signatures differ in at most
    LIMIT cells: every such pair shares a key of a chunk with one cell left out, and all pairs that share a key are
    compared. component_id is the smallest doc_id reachable by links; ``kept`` marks the documents that carry it.

    Shingles and sets are 64-bit hashes. Null text and text without words: no shingles, linked with nothing, kept. A null
    doc_id takes part and is never a component's name unless all of it is without. Repeated rows give repeated results,
    all kept if their doc_id is the smallest. Texts of any length are read whole. An empty table gives no rows; other
    columns are not read, so their names cannot clash.
    """
    stages = Stages(docs.sparkSession, "near_dedup")
    with arrow_rows(stages.spark, WIDE_ROWS):
        rows = stages.table(signed(docs))
    sets = stages.table(rows.where("s0 is not null").withColumnRenamed("set_id", "id").drop("doc_id").dropDuplicates(["id"]))
    members = rows.select("doc_id", "n", "set_id")
    label = set_links(stages, docs, sets).withColumnRenamed("id", "set_id")
    own = members.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("k"))
    placed = stages.table(own.join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("k").alias("k")).where("k > 1").drop("k")
    names = stages.table(placed.select("set_id", "component").join(least, "component").select("set_id", "component_id"))
    out = members.join(few(names), "set_id", "left")
    name = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
                                      WHEN len(w) > 0 THEN [chr(1) || array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, b.y FROM r JOIN b ON r.m = b.x)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, documents.doc_id = m AS kept
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT d, min(m) AS m FROM r GROUP BY 1) t ON t.d = documents.doc_id
"""
