"""Fuzzy line deduplication by MinHash, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import SPACES, Stages, components, read_table, row_key
from .quality import bind

#: Lines are sets of their GRAM-character shingles; a line shorter than that is one shingle. Different lines link at SIMILARITY.
GRAM, SIMILARITY = 5, 0.75
#: Signatures are MINIMA minima over those shingles. The hash of a shingle puts it into one of CLASSES classes, and every
#: class has its share of the minima, so that a shingle costs few of them. Those of a class order the hashes by other
#: leading bits (rotated by TURN), so that lines with few shingles still get different minima. The j-th belongs to class
#: j % CLASSES. A band joins the minima at the marks of RULER, moved on from band to band: marks in all classes, at
#: distances that all differ, so that two bands share one minimum at most. Six minima a band keep apart lines that have
#: little in common, of which there are about as many as the corpus has lines.
MINIMA, CLASSES, BANDS, RULER, TURN = 40, 8, 32, (0, 1, 4, 10, 15, 17), 6
#: Band rows are dealt out in so many parts, one after the other: the disk they need is that of a part.
PARTS = 8
#: Pairs that share a band are verified if so many of their MINIMA agree; at SIMILARITY 30 do on average.
AGREE = 22
#: Words of 64 bits in the parities of a line's shingles.
WORDS = 16
#: Rows of two numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rounds of stars before the remaining pairs of a band are compared, in blocks of BLOCK lines.
STAR_ROUNDS, BLOCK = 2, 1024

#: Bits of a minimum that signatures keep, and those of them that are compared.
_BITS, _BYTES = 16, 8
_KEPT = [f"p{i}" for i in range(MINIMA * _BITS // 64)]
_SIGNS = [f"s{i}" for i in range(len(_KEPT) // 2)]
_PARITIES = [f"w{i}" for i in range(WORDS)]


def _mask(i: int) -> int:
    """A constant whose xor with a hash gives the order of the i-th minimum; the sign bits alternate."""
    x = (i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 % (1 << 64)
    return (x ^ x >> 32) - (1 << 63)


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACES)))


def normal_lines(text: Column) -> Column:
    """The lines of a text as they are compared; empty for lines of white space, null for a null text."""
    return F.transform(F.split(text, "\n"), normal)


def shingle_rows(lines: DataFrame) -> DataFrame:
    """(id, n, h): the hash of each shingle of ``lines(id, norm, n)``, at every place."""
    # four bytes a character: a shingle is cut out at its place, however long the line
    chars = lines.select("id", "n", F.encode("norm", "utf-32").alias("c"), F.greatest(F.length("norm") - GRAM, F.lit(0)).alias("last"))
    places = chars.select("id", "n", "c", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    return places.select("id", "n", F.xxhash64(F.substring("c", 4 * F.col("i") + 1, F.lit(4 * GRAM))).alias("h"))


def minimum(k: int) -> Column:
    """The k-th minimum of the hashes ``h`` of a class."""
    h = F.shiftleft("h", k * TURN).bitwiseOR(F.shiftrightunsigned("h", 64 - k * TURN)) if k else F.col("h")
    return F.min(h.bitwiseXOR(F.lit(_mask(k))))


def packed(k: int) -> Column:
    """The last _BITS bits of 64 / _BITS minima."""
    own = 64 // _BITS
    low = lambda i: F.coalesce(F.col(f"m{i}").bitwiseAND((1 << _BITS) - 1), F.lit(0).cast("long"))
    return reduce(Column.bitwiseOR, [F.shiftleft(low(i), i % own * _BITS) for i in range(k * own, (k + 1) * own)]).alias(f"p{k}")


def kept(j: int) -> Column:
    """What a signature keeps of the j-th minimum."""
    own = 64 // _BITS
    return F.shiftrightunsigned(f"p{j // own}", j % own * _BITS).bitwiseAND((1 << _BITS) - 1)


def sign(k: int) -> Column:
    """A byte of each of 8 minima."""
    low = lambda i: F.col(f"p{i}").bitwiseAND(0xFF00FF00FF00FF)
    return low(2 * k).bitwiseOR(F.shiftleft(low(2 * k + 1), 8)).alias(f"s{k}")


def band(b: int) -> Column:
    """The hash of the b-th band of a signature."""
    return F.xxhash64(F.lit(b), *[kept((b * MINIMA // BANDS + r) % MINIMA) for r in RULER])


def signatures(lines: DataFrame) -> DataFrame:
    """(id, again, p0, ...) of each different line of ``lines(id, norm)``: if it occurs again, and _BITS bits of each minimum.

    Different lines are dealt by the id that the minima are grouped by, so that these need no further exchange. A class
    without shingles has no minima, which counts as a value of its own.
    """
    hashed = shingle_rows(lines.groupBy("id").agg(F.min("norm").alias("norm"), F.count("*").alias("n")))
    own = MINIMA // CLASSES
    classes = hashed.groupBy("id", F.col("h").bitwiseAND(CLASSES - 1).alias("class")).agg(
        F.max("n").alias("n"), *[minimum(k).alias(f"k{k}") for k in range(own)]
    )
    minima = classes.groupBy("id").agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("class") == j % CLASSES, F.col(f"k{j // CLASSES}"))).alias(f"m{j}") for j in range(MINIMA)
    ])
    return minima.select("id", (F.col("n") > 1).alias("again"), *[packed(k) for k in range(len(_KEPT))])


def agreeing(a: str, b: str, signs: list[str] = _SIGNS, minima: int = MINIMA) -> Column:
    """Minima with equal bytes in the signatures of the sides ``a`` and ``b``."""
    differ = F.lit(minima)
    for s in signs:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (4, 2, 1):  # the last bit of a byte becomes one if any of its bits is
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ - F.bit_count(x.bitwiseAND(int("01" * _BYTES, 16)))
    return differ


def shingles(norm: Column) -> Column:
    """Hashes (64 bits) of all different shingles."""
    last = F.greatest(F.length(norm) - GRAM, F.lit(0))
    return bind(F.encode(norm, "utf-32"), lambda c: F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(c, 4 * i + 1, F.lit(4 * GRAM)))
    ))


def parities(lines: DataFrame) -> DataFrame:
    """(id, n, w0, ...) of different ``lines(id, norm)``: how many different shingles each has, and 64 * WORDS bits, each one
    if an odd number of them fall on it."""
    each = lines.select("id", F.explode(F.array_distinct(shingles(F.col("norm")))).alias("h"))
    words = each.groupBy("id", F.col("h").bitwiseAND(WORDS - 1).alias("word")).agg(
        F.count("*").alias("n"), F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 58).cast("int"))).alias("w")
    )
    return words.groupBy("id").agg(
        F.sum("n").alias("n"), *[F.max(F.when(F.col("word") == k, F.col("w"))).alias(w) for k, w in enumerate(_PARITIES)]
    ).na.fill(0, _PARITIES)


def may_link(a: str, b: str) -> Column:
    """Sizes and parities that allow a link of the sides ``a`` and ``b``; true for every pair that links.

    Each bit in which the parities differ takes a shingle that one line alone has, and at a similarity of s at most
    (1 - s) / (1 + s) of the lines' shingles, counted together, are such.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in _PARITIES])
    return (F.least(na, nb) >= SIMILARITY * F.greatest(na, nb)) & (differ * (1 + SIMILARITY) <= (na + nb) * (1 - SIMILARITY))


def similar(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b, t_a, t_b)`` whose texts have a Jaccard similarity of SIMILARITY or more."""
    sets = pairs.select("a", "b", F.array_distinct(shingles(F.col("t_a"))).alias("g_a"), F.array_distinct(shingles(F.col("t_b"))).alias("g_b"))
    sizes = sets.select("a", "b", F.size("g_a").alias("n_a"), F.size("g_b").alias("n_b"), F.size(F.array_intersect("g_a", "g_b")).alias("both"))
    return sizes.where(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")) >= SIMILARITY).select("a", "b")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def similar_lines(stages: Stages, signed: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, component) of the different lines that link with another one; ``signed`` holds the signatures of ``lines(id, norm)``.

    The lines of a band are compared with one of them, the one with most neighbours (near copies are nearer to their
    original than to each other). In the next rounds those left apart are compared with one of them again. At last all
    pairs of a band that lie in different components are compared, in blocks: no pair that shares a band goes unseen.
    Compared pairs whose signatures agree and whose parities allow a link are verified from their texts.
    """
    groups = joined = None
    for part in range(PARTS):
        keyed = signed.select("id", F.explode(F.array(*[band(b) for b in range(part, BANDS, PARTS)])).alias("band"))
        shared = stages.table(
            keyed.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("k")).where("lo < hi")
        )
        crowd = stages.table(keyed.join(small(shared.where("k > 2").select("band", "k")), "band"))
        groups, joined = (groups.union(shared), joined.union(crowd)) if part else (shared, crowd)
    degree = joined.groupBy("id").agg(F.sum("k").alias("degree"))
    members = stages.table(joined.select("band", "id").join(degree, "id"))
    twos = groups.where("k = 2")
    nodes = small(stages.table(members.select("id").union(twos.select(F.explode(F.array("lo", "hi")))).distinct()))
    texts = stages.table(lines.join(nodes, "id", "left_semi").groupBy("id").agg(F.min("norm").alias("norm")))
    signs = stages.table(signed.select("id", *[sign(k) for k in range(len(_SIGNS))]).join(parities(texts), "id"))
    # told to be without nulls, comparisons are short enough to be compiled
    signs = signs.select("id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", *_SIGNS, *_PARITIES)])

    def agreed(pairs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
        side = lambda x: signs.withColumnRenamed("id", x).alias(x)
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link("a", "b") & (agreeing("a", "b") >= AGREE)).select("a", "b")
        return stages.table(near.join(seen, ["a", "b"], "left_anti") if seen is not None else near)

    def linked(pairs: DataFrame, label: DataFrame | None = None) -> DataFrame:
        side = lambda x: texts.select(F.col("id").alias(x), F.col("norm").alias(f"t_{x}"))
        edges = similar(pairs.join(side("a"), "a").join(side("b"), "b"))
        known = label.select(F.col("id").alias("a"), F.col("component").alias("b")) if label is not None else None
        return components(stages, edges.union(known) if known is not None else edges)

    found = agreed(twos.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(star_pairs(members)).distinct())
    label = linked(found)
    for _ in range(STAR_ROUNDS):
        members = stages.table(mixed_members(members, label))
        fresh = agreed(star_pairs(members), found)
        if fresh.isEmpty():
            break
        found, label = found.union(fresh), linked(fresh, label)
        members = members.select("band", "id", "degree")
    rest = stages.table(mixed_members(members.select("band", "id", "degree"), label).select("band", "id", "component"))
    own = rest.groupBy("id").agg(F.collect_list("band").alias("own"))
    size = rest.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sized = rest.join(size, "band").join(stages.table(own), "id").join(signs, "id")
    left = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = sized.withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
    at = lambda c: F.col(f"x.{c}") == F.col(f"y.{c}")
    near = (F.col("x.component") < F.col("y.component")) & may_link("x", "y") & (agreeing("x", "y") >= AGREE)
    near = near & (F.array_min(F.array_intersect("x.own", "y.own")) == F.col("x.band"))  # once, however many bands they share
    cross = left.alias("x").join(right.alias("y"), at("band") & at("block") & near).select(*pair(F.col("x.id"), F.col("y.id")))
    cross = stages.table(cross.join(found, ["a", "b"], "left_anti"))
    return label if cross.isEmpty() else linked(cross, label)


def pair(x: Column, y: Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def star_pairs(members: DataFrame) -> DataFrame:
    """Different (a, b): the centre of each band and its other members.

    The centre is the member with the highest degree. Where members carry components, it is the highest outside
    ``main``, and members of its own component are left out.
    """
    known = "component" in members.columns
    centre = members.where("component <> main") if known else members
    centre = centre.groupBy("band").agg(F.max(F.struct("degree", "id", *(["component"] if known else []))).alias("c"))
    apart = F.col("component") != F.col("c.component") if known else F.col("id") != F.col("c.id")
    return members.join(centre, "band").where(apart).select(*pair(F.col("id"), F.col("c.id"))).distinct()


def mixed_members(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members of bands whose lines lie in different components; ``main`` is the component of the one with the highest degree."""
    marked = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = marked.groupBy("band").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("degree", "id", "component"))["component"].alias("main")
    ).where("lo < hi").select("band", "main")
    return marked.join(mixed, "band").select("band", "id", "degree", "component", "main")


def dropped_lines(stages: Stages, rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(_row, dropped): numbers of the lines of different ``rows(_row, _order, _ids)`` that repeat an earlier line of any row."""
    signed = stages.table(signatures(lines))
    label = similar_lines(stages, signed, lines)
    again = signed.where("again").select("id").join(label, "id", "full_outer").select("id", F.coalesce("component", "id").alias("component"))
    placed = rows.select("_row", "_order", F.posexplode("_ids").alias("line_no", "id")).join(small(stages.table(again)), "id")
    placed = stages.table(placed.select("component", F.struct("_order", "_row", "line_no").alias("at")))
    stages.drop(signed)
    first = small(stages.table(placed.groupBy("component").agg(F.min("at").alias("first"))))
    later = placed.join(first, "component").where(~F.col("at").eqNullSafe(F.col("first")))
    out = stages.table(later.groupBy("at._row").agg(F.sort_array(F.collect_list("at.line_no")).alias("dropped")))
    stages.drop(placed)
    return out


def line_ids(text: Column) -> Column:
    """The id of each line of a text, null for lines of white space."""
    return F.transform(normal_lines(text), lambda x: F.when(x != "", F.xxhash64(x)))


def dedup_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs`` with repeated lines removed from text, plus ``n_lines`` and ``dropped`` (line numbers from 0).

    Lines are the \\n-split parts of whole texts, compared trimmed and in lower case. Equal lines repeat each other;
    different ones link when the Jaccard similarity of their character shingles is at least SIMILARITY and MinHash
    bands propose them (over 0.95 of such pairs). Of each connected component the first line stays, by doc_id, row_key
    and line number; all others go. Lines of white space only stay. ``with_text=False`` leaves text out of the result.
    No text is staged: rows are known by row_key, which every reading finds again.

    Null text: no lines, stays null. A text whose lines all go becomes empty. Null doc_id orders first. Of rows equal in
    all columns one keeps its lines, the others lose all. An empty table gives no rows. Other columns pass through,
    whatever their names, but an input column ``n_lines`` or ``dropped`` gives way to the result's.
    Line ids and shingles are 64-bit hashes. Very long lines and texts are read whole.
    """
    stages = Stages(docs.sparkSession, "line_dedup")
    own = [c for c in docs.columns if c not in ("text", "n_lines", "dropped")]
    whole = docs.select(F.struct(*own).alias("_doc"), F.col("text").cast("string").alias("text"), row_key(docs).alias("_row"))
    rows = stages.table(whole.select("_row", F.col("_doc.doc_id").alias("_order"), line_ids(F.col("text")).alias("_ids")))
    twice = stages.table(rows.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").select("_row"))
    some_twice = not twice.isEmpty()
    lines = docs.select(F.explode(normal_lines(F.col("text").cast("string"))).alias("norm")).where("norm <> ''").select(F.xxhash64("norm").alias("id"), "norm")
    gone = small_lists(dropped_lines(stages, rows.dropDuplicates(["_row"]) if some_twice else rows, lines))
    stages.drop(rows)
    whole = whole.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    joined = whole.join(gone, "_row", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    if some_twice:
        copy = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
        every = F.filter(F.transform(line_ids(F.col("text")), lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
        copies = joined.join(small(twice), "_row", "left_semi").withColumn("copy", copy)
        copies = copies.withColumn("dropped", F.when(F.col("copy") == 1, F.col("dropped")).otherwise(F.coalesce(every, F.col("dropped")))).drop("copy")
        joined = joined.join(small(twice), "_row", "left_anti").unionByName(copies)
    if not with_text:
        return joined.select("_doc.*", "n_lines", "dropped")
    parts = F.split("text", "\n")
    numbered = F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.filter(numbered, lambda e: ~F.array_contains("dropped", e["i"]))
    text = F.when(F.size("dropped") > 0, F.array_join(F.transform(kept, lambda e: e["x"]), "\n")).otherwise(F.col("text"))
    return joined.select("_doc.*", text.alias("text"), "n_lines", "dropped")


def small_lists(gone: DataFrame) -> DataFrame:
    """``gone`` with a broadcast hint if its line numbers allow it."""
    size = gone.agg(F.sum(F.size("dropped") + 6)).first()[0] or 0
    return F.broadcast(gone) if size <= BROADCAST_IDS else gone


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, with_text=False).select(
        "doc_id", F.col("n_lines").cast("long"), F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"),
    )
