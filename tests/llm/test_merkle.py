"""The manifest against a plain recursion, with small blocks and tops so that every round is taken."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, pos long, node string, leaf string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    said = [row[k] for k in ("doc_id", "source", "lang", "n_chars", "text")]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in said])


def plain_tree(nodes):
    """(root, siblings of each leaf as (left?, digest)) by the definition."""
    own, paths = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        pairs = [range(i, min(i + 2, len(nodes))) for i in range(0, len(nodes), 2)]
        for p in pairs:
            for i in p:
                for leaf in own[i]:
                    paths[leaf].append([(j < i, nodes[j]) for j in p if j != i])
        own = [[leaf for i in p for leaf in own[i]] for p in pairs]
        nodes = [h(*[nodes[i] for i in p]) for p in pairs]
    return nodes[0], paths


def plain_manifest(data):
    trees = {}
    for row in data:
        trees.setdefault(row["lang"], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs, out = [], []
    for t in order:
        rows = sorted(trees[t], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[t] = rows, plain_tree([plain_leaf(r) for r in rows])
        subs.append(trees[t][1][0])
    root, above = plain_tree(subs)
    for i, t in enumerate(order):
        rows, (sub, paths) = trees[t]
        for r, path in zip(rows, paths):
            claimed, path = dict(r), path + above[i]
            if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                claimed["n_chars"] += 1
            node = plain_leaf(claimed)
            for step in path:
                node = h(*[x for left, x in step if left], node, *[x for left, x in step if not left])
            out.append((r["doc_id"], plain_leaf(r), sub, root, h(*[x for step in path for _, x in step]), node))
    return sorted(out, key=repr)


def manifest(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.merkle_manifest(df, merkle.FIELDS, "doc_id", "lang", {"n_chars": F.col("n_chars") + F.when(tampered, 1).otherwise(0)})
    return sorted(
        (tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root").collect()), key=repr
    )


def table(n, langs):
    texts = [None, "", "x", "\u00e9\u4e2d" * 40, "long " * 30_000]
    data = [(i * 5 % 97, texts[i % 5], langs[i * i % len(langs)], [None, "s"][i % 2], [None, 3, i][i % 3], 1, 2, "n", "f") for i in range(n)]
    return data + data[:3] + ([(None, None, None, None, None, 1, 2, "n", "f")] * 2 if n else [])


@pytest.mark.parametrize("levels,top", [(10, 10_000), (2, 10_000), (1, 6), (2, 12), (3, 2)])
def test_manifest_against_the_plain_tree(rows, monkeypatch, levels, top):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "TOP", top)
    data = table(60, [None, "en", "zz", "\u00e9", "\U0001f600", "\uffee", "a", "b"])
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    assert manifest(rows(SCHEMA, data)) == plain_manifest([dict(zip(names, r)) for r in data])


def test_manifest_of_one_tree_one_row_and_none(rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for data in (table(33, ["en"]), table(1, ["en"])[:1], []):
        assert manifest(rows(SCHEMA, data)) == plain_manifest([dict(zip(names, r)) for r in data]) if data else manifest(rows(SCHEMA, data)) == []


def test_proofs_hold_and_claims_show(spark):
    out = merkle.op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and len({r.root for r in out}) == 1
    assert {r.verified for r in out if crc32(str(r.doc_id).encode()) % 7} == {True}
    assert {r.verified for r in out if crc32(str(r.doc_id).encode()) % 7 == 0} == {False}
    real = merkle.merkle_manifest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), merkle.FIELDS, "doc_id", "lang").collect()
    assert all(r.folded_root == r.root == merkle.fold(r.leaf, r.sides, r.proof) for r in real)
