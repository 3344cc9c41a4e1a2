"""Near-dedup against brute force, and the guarantee of its keys."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quern.llm import near_dedup
from quern.llm.ngram_join import Shingler

SCHEMA = "doc_id long, text string, n long, id long, band string, component int, s0 string"
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def plain(docs):
    sets = [shingles(t) for _, t in docs]
    name = list(range(len(docs)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                name[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        least = min(ids, default=None)
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=repr)


def found(rows, docs):
    out = near_dedup.near_duplicates(rows(SCHEMA, [(*d, 1, 2, "x", 3, "s") for d in docs]).repartition(3))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def families(seed, kinds):
    """Texts near to one of some originals, at similarities around the limit, chains of them, and texts with one long common passage."""
    rng = random.Random(seed)
    common, texts = [f"c{i}" for i in range(40)], []
    for k in range(kinds):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 12, 60, 150, 400]))]
        for _ in range(6):
            texts.append(edited(rng, words, rng.randrange(1 + len(words) // 25)))
        chain = words
        for _ in range(4):
            chain = edited(rng, chain, max(1, len(words) // 40))
            texts.append(chain)
        texts.append(common + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 40))])
    return [" ".join(t) for t in texts]


ODD = [None, "", " \n\t", "one", "One", "two words", "two  words", "a b c d", "A b c D e", "x " * 60_000, "x " * 7]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_against_brute_force(rows, monkeypatch, seed):
    if seed == 2:  # every way of the joins, on small data
        for name, value in (("BLOCK_SETS", 20), ("OWN_SETS", 2), ("BLOCK", 3), ("SMALL", 3), ("NEAREST_ROUNDS", 1), ("BROADCAST_IDS", 0)):
            monkeypatch.setattr(near_dedup, name, value)
    texts = families(seed, 18) + ODD
    docs = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    docs += [(None, texts[0]), (None, "all alone here it is"), (docs[5][0], docs[5][1]), (docs[5][0], docs[5][1])]
    assert found(rows, docs) == plain(docs)


def test_wide_rows_go_to_workers_a_few_at_a_time(spark, rows, monkeypatch):
    """Batches of whole texts and of pairs of whole sets are what an executor's memory holds most of."""
    key, steps, table = "spark.sql.execution.arrow.maxRecordsPerBatch", [], near_dedup.Stages.table
    before = spark.conf.get(key)

    def told(self, df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        steps.append((int(spark.conf.get(key)), "MapInArrow" in plan, set(df.columns)))
        return table(self, df)

    monkeypatch.setattr(near_dedup.Stages, "table", told)
    docs = [(i, t) for i, t in enumerate(families(3, 4))]
    assert found(rows, docs) == plain(docs) and spark.conf.get(key) == before
    wide = [n for n, python, columns in steps if python and columns & {"n", "shared", "a"} and "d" not in columns]
    assert len(wide) >= 3 and max(wide) <= 500
    assert any(n == int(before) for n, python, _ in steps if python)


def test_pairs_that_cannot_link_are_not_verified(rows, monkeypatch):
    """Texts with one long common passage: all their signatures are within the limit, and no two of them link."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(240)]
    docs = [(i, " ".join(common + [f"u{rng.randrange(10**9)}" for _ in range(45 + i % 7)])) for i in range(70)]
    other = [f"d{i}" for i in range(240)]
    docs += [(100 + i, " ".join(other[: 60 + i] + [f"v{i}"] + other[61 + i :])) for i in range(3)]
    handed, verify = [], near_dedup.verify
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, *more: handed.append(pairs.count()) or verify(pairs, *more))
    assert found(rows, docs) == plain(docs)
    assert len({c for _, _, c, _ in plain(docs)}) > 65 and sum(handed) < 4 * len(docs)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 5, 29, 32, 60, 65, 300, 1030, 5000, 9000]), st.floats(0, 0.25))
def test_parities_let_all_links_through(seed, size, apart):
    rng = np.random.default_rng(seed)
    a, b, c = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (size, int(rng.integers(0, 1 + apart * size)), int(rng.integers(0, 1 + apart * size))))
    a, b = np.unique(np.concatenate([a, b])), np.unique(np.concatenate([a, c]))
    alone, both = len(np.setxor1d(a, b)), len(np.intersect1d(a, b))
    known = near_dedup.Parities(np.array([near_dedup.parity(a), near_dedup.parity(b)], object))
    differing = known.differing(np.array([0]), np.array([1]))[0]
    assert differing <= alone and (alone - differing) % 2 == 0
    if 100 * both >= 80 * (len(a) + len(b) - both):
        assert near_dedup.parities_allow(differing, len(a) + len(b))


def test_near_dedup_of_nothing(rows):
    assert found(rows, []) == [] and found(rows, [(4, None)]) == [(4, 0, 4, True)]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, near_dedup.LIMIT))
def test_signatures_within_the_limit_share_a_key(seed, differing):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, near_dedup.CELLS_ALL, np.uint8)
    b = a.copy()
    at = rng.permutation(near_dedup.CELLS_ALL)[:differing] if seed % 2 else np.arange(differing) * 2 % near_dedup.CELLS_ALL
    b[at] += rng.integers(1, 256, len(at), np.uint8)
    x, y = near_dedup.chunk_keys(np.stack([a, b])).tolist()
    same = [p for p, q in zip(x, y) if p == q]
    assert same and near_dedup.first_key(a[None], b[None])[0] == near_dedup.first_key(b[None], a[None])[0] == same[0]


def test_distance_follows_similarity():
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2_000)]
    far = []
    for _ in range(60):
        other = edited(rng, words, 55)
        a, b = Shingler(4)(" ".join(words)), Shingler(4)(" ".join(other))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        d = int((near_dedup.signature(a) != near_dedup.signature(b)).sum())
        far.append(d / near_dedup.CELLS_ALL - (1 - j))
    assert abs(np.mean(far)) < 0.02 and np.std(far) < 0.05


def test_near_dedup_on_documents(spark, rows):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, near_dedup.op13_near_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr) == plain(docs)
