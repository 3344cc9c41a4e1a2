"""Ranked search against the definition, with repeated, null and sparse doc_ids and small windows and blocks."""

import math
import re
from collections import Counter

import pytest

from quern.llm import search

DOCS = "doc_id long, text string, score long, rank int, item_id long, win long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    rows = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in of.items():
        scored = []
        for d, c in rows:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted if c[t]
            )
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


WORDS = ["alpha", "Beta", "\u00c9t\u00e9", "\u00e9t\u00e9", "x1", "\u4e2d\u6587", "k-9", "A_B", "zeta", "\U0001f600"]
TEXTS = [" ".join(WORDS[(i * j + j * j) % len(WORDS)] for j in range(i % 17)) for i in range(90)]
TEXTS += [None, "", " \n", "!!", "\x00", TEXTS[16], TEXTS[16], TEXTS[16].upper(), "rare " * 70_000 + "\u00df" * 5]
ITEMS = [(1, "alpha \u00c9T\u00c9 rare"), (2, None), (3, "nothing"), (4, ""), (None, "x1 beta"), (5, "zeta"), (5, "BETA zeta"), (6, "A_B \u4e2d\u6587 \u00df\u00df\u00df\u00df\u00df")]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("ids", [lambda i: i, lambda i: 7, lambda i: i * 10**15 - 5 * 10**16, lambda i: None if i % 3 == 0 else -i // 4])
def test_search_against_the_definition(rows, monkeypatch, ids, small):
    if small:
        for name, value in (("WINDOW", 16), ("BLOCK_DOCS", 7), ("ITEM_BLOCK", 3), ("OWN_ROWS", 1), ("SLICE", 5)):
            monkeypatch.setattr(search, name, value)
    docs = [(ids(i), t) for i, t in enumerate(TEXTS)]
    got = search.ranked_search(
        rows(DOCS, [(*d, 1, 2, 3, 4) for d in docs]).repartition(3), rows("item_id long, text string, doc_id long, terms string", [(*i, 0, "t") for i in ITEMS]), 10
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, ITEMS, 10)


def test_search_of_empty_tables(rows):
    none, some = rows("doc_id long, text string", []), rows("item_id long, text string", ITEMS)
    assert search.ranked_search(none, some, 10).count() == 0
    assert search.ranked_search(rows("doc_id long, text string", [(1, "alpha")]), some.limit(0), 10).count() == 0


def test_search_on_documents(spark):
    at = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, search.op11_lexical_search(spark, at).collect()), key=repr) == plain(docs, items, 10)
