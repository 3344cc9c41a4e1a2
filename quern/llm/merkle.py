"""Merkle manifest of a table: executors reduce large blocks, the driver builds the small top, executors finish proofs and folds."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Stages, read_table

#: Levels of the tree within a block: a block has at most 2 ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 10
#: Nodes from which the driver builds the top of the trees; their suffix paths, under 100 levels of 65 bytes each, are broadcast.
TOP = 10_000
#: A sibling on the left, on the right, or none.
LEFT, RIGHT, NONE = "L", "R", "-"


def fields_digest(columns: dict[str, Column]) -> Column:
    """sha256 of the values, each ``-`` if null, else its UTF-8 bytes with their count and a colon before them."""
    parts = []
    for c in columns.values():
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def digest(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels above them; every two consecutive nodes become one, a last single one too."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(levels: list[list[str]], at: int) -> tuple[str, str]:
    """(sides, proof) of the node at a place: for each level the sibling's side, and the digests of those there are."""
    sides, proof = [], []
    for level in levels[:-1]:
        other = at ^ 1
        there = other < len(level)
        sides.append(NONE if not there else LEFT if other < at else RIGHT)
        if there:
            proof.append(level[other])
        at >>= 1
    return "".join(sides), "".join(proof)


def fold(node: str, sides: str, proof: str) -> str:
    """The root that a node and its siblings give."""
    at = 0
    for side in sides:
        if side == NONE:
            node = digest(node)
            continue
        other, at = proof[at : at + 64], at + 64
        node = digest(other, node) if side == LEFT else digest(node, other)
    return node


def numbered(stages: Stages, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in the order of the columns, nulls first; equal rows in any order.

    Rows are dealt by ranges; a place is that within its range plus the sizes of the ranges before, one number a task.
    """
    tie = "_tie"
    keyed = rows.withColumn(tie, F.monotonically_increasing_id())  # equal rows can be split between ranges
    ranged = keyed.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    placed = stages.table(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()))
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("at", within + F.col("_before"))
        .drop("_part", "_before", "_at")
    )


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", BLOCK_LEVELS))


def _nodes(table: pa.Table) -> tuple[pa.Table, list[list[str]]]:
    """A block's rows by their place, and its levels."""
    table = table.sort_by("pos")
    levels = min(BLOCK_LEVELS, depth(table.column("size")[0].as_py()))
    return table, reduced([x.hex() for x in table.column("node").to_pylist()], levels)


def reduce_blocks(nodes: DataFrame) -> DataFrame:
    """The nodes BLOCK_LEVELS higher up in each tree of ``nodes(tree, pos, size, node)``, or the tree's root."""

    def top(table: pa.Table) -> pa.Table:
        table, levels = _nodes(table)
        return pa.table({
            "tree": table.column("tree")[:1], "pos": table.column("block")[:1], "size": table.column("size")[:1],
            "node": pa.array([bytes.fromhex(levels[-1][0])], pa.binary()),
        })

    same = "tree long, pos long, size long, node binary"
    blocks = in_blocks(nodes.select("tree", "pos", "size", "node")).groupBy("tree", "block").applyInArrow(top, same)
    return blocks.withColumn("size", F.shiftright(F.col("size") + ((1 << BLOCK_LEVELS) - 1), BLOCK_LEVELS))


PATH = "subroot string, root string, sides string, proof string"


def top_paths(rows: list, whole: bool) -> list[tuple]:
    """(tree, pos, subroot, root, sides, proof) of the nodes ``(tree, pos, node)``, from the trees' tops and the tree of their roots.

    ``whole``: the nodes are the roots of all trees already, as leaves of one tree; the subroots are then filled in below.
    """
    trees: dict[int, list[str]] = {}
    for tree, _, node in sorted(rows, key=lambda r: (r[0], r[1])):
        trees.setdefault(tree, []).append(node.hex())
    built = {tree: reduced(nodes, depth(len(nodes))) for tree, nodes in trees.items()}
    ids = sorted(built)
    tops = [built[t][-1][0] for t in ids]
    above = reduced(tops, depth(len(tops)))
    out = []
    for i, t in enumerate(ids):
        sides, proof = siblings(above, i)
        for pos in range(len(trees[t])):
            s, p = siblings(built[t], pos)
            out.append((t, pos, None if whole else tops[i], above[-1][0], s + sides, p + proof))
    return out


def paths(stages: Stages, nodes: DataFrame, whole: bool = False) -> DataFrame:
    """(tree, pos, PATH) of ``nodes(tree, pos, size, node)``: the siblings from each node to the root over all trees."""
    spark = nodes.sparkSession
    many, highest = nodes.agg(F.count("*"), F.max("size")).first()
    if many <= TOP:
        top = top_paths([tuple(r) for r in nodes.select("tree", "pos", "node").collect()], whole)
        return F.broadcast(spark.createDataFrame(top, f"tree long, pos long, {PATH}"))
    if highest > 1:
        above = paths(stages, stages.table(reduce_blocks(nodes)), whole)

        def extended(table: pa.Table) -> pa.Table:
            table, levels = _nodes(table)
            own = [siblings(levels, i) for i in range(table.num_rows)]
            table = table.drop_columns(["block", "size", "node"])
            for c, k in (("sides", 0), ("proof", 1)):
                rest = table.column(c)[0].as_py()
                table = table.set_column(table.column_names.index(c), c, pa.array([x[k] + rest for x in own], pa.string()))
            return table

        return stages.table(with_paths(nodes, above).groupBy("tree", "block").applyInArrow(extended, f"tree long, pos long, {PATH}"))
    # more trees than the driver takes, each reduced to its root: they are the leaves of one more tree
    roots = stages.table(numbered(stages, nodes.select("tree", "node"), ["tree"]))
    leaves = roots.select(F.lit(0).cast("long").alias("tree"), F.col("at").alias("pos"), F.lit(many).cast("long").alias("size"), "node")
    joined = roots.join(paths(stages, leaves, True).drop("tree"), F.col("at") == F.col("pos"))
    return joined.select(
        "tree", F.lit(0).cast("long").alias("pos"), F.lower(F.hex("node")).alias("subroot"), "root", "sides", "proof"
    )


def with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` dealt by block, with the path of the block's top."""
    return in_blocks(nodes).repartition("tree", "block").join(above.withColumnRenamed("pos", "block"), ["tree", "block"])


def merkle_manifest(
    docs: DataFrame, fields: list[str], order: str, tree: str, claims: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, proof, sides, folded_root.

    A leaf is ``fields_digest`` of ``fields``. The leaves of each value of ``tree`` ascend by ``order``; while there are
    several nodes, every two consecutive ones (a last single one too) become the digest of their hexadecimal texts. What
    remains is the subroot; the subroots, ordered by ``tree`` in UTF-8 bytes, give root in the same way. ``proof`` holds the
    digests of the siblings from the leaf to the root, one after the other, ``sides`` the side of each level (L, R, or -
    where there is none). ``folded_root`` is what ``fold`` gives for the leaf of the row with the values in ``claims``
    (columns over ``docs``) in place of its own: a claim that differs from what the manifest was built on gives another root.

    Leaves are hashed in one scan and staged without texts; ranges number them. Blocks of 2 ** BLOCK_LEVELS nodes are
    reduced on the executors, round after round, until TOP nodes are left over all trees; of these the driver builds the
    tops and broadcasts the paths, with which executors finish the proofs of each block and fold every row. Trees with one
    root each but more than TOP of them become one tree that is reduced in the same way.

    Nulls in any field have their own mark; a null ``order`` comes first, and so does the tree of a null. Empty and very
    long texts are hashed whole. Rows with an equal ``order`` ascend by leaf; rows equal in all fields share a leaf and get
    the places in any order. An empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    stages = Stages(docs.sparkSession, "merkle")
    own = {c: F.col(c) for c in fields}
    said = own | (claims or {})
    same = F.lit(True)
    for c in claims or {}:
        same = same & said[c].eqNullSafe(own[c])
    leaves = stages.table(docs.select(
        F.struct(F.col(tree).alias("tree")).alias("named"), F.col(order).alias("key"), fields_digest(own).alias("node"),
        F.when(~same, fields_digest(said)).alias("claim"),
    ))
    placed = stages.table(numbered(stages, leaves, ["named", "key", "node"]))
    stages.drop(leaves)
    trees = stages.table(placed.groupBy("named").agg(F.min("at").alias("tree"), F.count("*").alias("size")))
    trees = F.broadcast(trees) if trees.count() <= TOP else trees
    nodes = stages.table(placed.join(trees, "named").select("tree", (F.col("at") - F.col("tree")).alias("pos"), "size", "key", "node", "claim"))
    stages.drop(placed)
    above = paths(stages, stages.table(reduce_blocks(nodes)))

    def finished(table: pa.Table) -> pa.Table:
        table, levels = _nodes(table)
        sides, proof = table.column("sides")[0].as_py(), table.column("proof")[0].as_py()
        known: dict[str, str] = {}  # what the path above the block makes of a node

        def folded(node: str, s: str, p: str) -> str:
            node = fold(node, s, p)
            if node not in known:
                known[node] = fold(node, sides, proof)
            return known[node]

        own = [siblings(levels, i) for i in range(table.num_rows)]
        claims = [x.hex() if x else leaf for x, leaf in zip(table.column("claim").to_pylist(), levels[0])]
        return pa.table({
            order: table.column("key"), "leaf": levels[0], "subroot": table.column("subroot"), "root": table.column("root"),
            "proof": [p + proof for _, p in own], "sides": [s + sides for s, _ in own],
            "folded_root": [folded(c, s, p) for c, (s, p) in zip(claims, own)],
        })

    kind = docs.select(F.col(order).alias("key")).schema[0].dataType.simpleString()
    return with_paths(nodes, above).groupBy("tree", "block").applyInArrow(
        finished, f"`{order}` {kind}, leaf string, subroot string, root string, proof string, sides string, folded_root string"
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claims = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return merkle_manifest(docs, FIELDS, "doc_id", "lang", claims).select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_LEAF_SQL = " || ".join(
    f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS
)
_CLAIM_SQL = _LEAF_SQL.replace("CAST(n_chars AS VARCHAR)", "CAST(n_chars + 1 AS VARCHAR)")
#: crc32 of a decimal: a byte is xored in, then eight shifts.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, lang, sha256({_LEAF_SQL}) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND {_CRC_SQL} % 7 = 0 THEN sha256({_CLAIM_SQL}) ELSE sha256({_LEAF_SQL}) END AS claim
  FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
a(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM p
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, h, (n + 1) // 2 FROM (
    SELECT tree, lvl, pos, sha256(h || coalesce(lead(h) OVER (PARTITION BY tree ORDER BY pos), '')) AS h, n FROM a WHERE n > 1) WHERE pos % 2 = 0
), s AS (SELECT tree, lvl, h FROM a WHERE n = 1),
u(lvl, pos, h, n) AS (
  SELECT 0, tree, h, count(*) OVER () FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, h, (n + 1) // 2 FROM (
    SELECT lvl, pos, sha256(h || coalesce(lead(h) OVER (ORDER BY pos), '')) AS h, n FROM u WHERE n > 1) WHERE pos % 2 = 0
), e AS (
  SELECT p.id, a.lvl AS lvl, (p.pos >> a.lvl) % 2 AS side, o.h AS h
  FROM p JOIN a ON a.tree = p.tree AND a.n > 1 AND a.pos = p.pos >> a.lvl LEFT JOIN a o ON o.tree = a.tree AND o.lvl = a.lvl AND o.pos = xor(a.pos, 1)
  UNION ALL
  SELECT p.id, s.lvl + u.lvl, (p.tree >> u.lvl) % 2, o.h
  FROM p JOIN s ON s.tree = p.tree JOIN u ON u.n > 1 AND u.pos = p.tree >> u.lvl LEFT JOIN u o ON o.lvl = u.lvl AND o.pos = xor(u.pos, 1)
), f(id, lvl, h) AS (
  SELECT id, 0, claim FROM p
  UNION ALL
  SELECT f.id, f.lvl + 1, sha256(CASE WHEN e.h IS NULL THEN f.h WHEN e.side = 1 THEN e.h || f.h ELSE f.h || e.h END) FROM f JOIN e ON e.id = f.id AND e.lvl = f.lvl
), g AS (SELECT id, arg_max(h, lvl) AS folded FROM f GROUP BY 1),
q AS (SELECT id, string_agg(h, '' ORDER BY lvl) AS proof FROM e GROUP BY 1),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p JOIN s ON s.tree = p.tree JOIN r ON true JOIN g ON g.id = p.id LEFT JOIN q ON q.id = p.id
"""
