import hashlib

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.chunking import token_estimate

TEXTS = ["", "向 量", "向量搜索", "a", "ab c", "😀 x　y\x1cz", "hello world", "混合 text 文本", None]


def test_char_ngrams(rows):
    df = rows("t string", [(t,) for t in TEXTS])
    for n in (1, 2, 3):
        for r in df.select("t", T.char_ngrams(F.col("t"), n).alias("g")).collect():
            bare = "".join((r["t"] or "").split())
            want = [bare[i : i + n] for i in range(len(bare) - n + 1)] or ([bare] if bare else [])
            assert r["g"] == want
    with pytest.raises(ValueError):
        T.char_ngrams(F.col("t"), 0)


def test_estimate_tokens(rows):
    texts = [t for t in TEXTS if t is not None] + ["x" * n for n in range(1, 60)] + ["汉" * n for n in range(1, 20)]
    for r in rows("t string", [(t,) for t in texts]).select("t", T.estimate_tokens(F.col("t")).alias("n")).collect():
        assert r["n"] == token_estimate(r["t"])
    assert token_estimate("") == 0


def test_hashes(rows):
    df = rows("k string, t string", [("ab", "c"), ("a", "bc"), ("", "　x ")])
    got = df.select("k", "t", T.framed_sha256(F.col("k"), F.col("t")).alias("f"), T.document_id(F.col("t")).alias("d"), T.git_blob_sha1(F.encode("t", "UTF-8")).alias("g")).collect()
    for r in got:
        frame = b"".join(len(x.encode()).to_bytes(8, "big") + x.encode() for x in (r["k"], r["t"]))
        assert r["f"] == hashlib.sha256(frame).hexdigest()
        assert r["d"] == hashlib.sha256(r["t"].strip().encode()).hexdigest()[:16]
        assert r["g"] == hashlib.sha1(b"blob %d\0" % len(r["t"].encode()) + r["t"].encode()).hexdigest()
    assert got[0]["f"] != got[1]["f"]


def test_containment_and_jaccard(rows):
    df = rows("a array<string>, b array<string>", [(["x", "y", "x"], ["x"]), ([], ["x"])])
    got = df.select(T.containment(F.col("a"), F.col("b")), T.jaccard(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (0.0, 0.0)]
