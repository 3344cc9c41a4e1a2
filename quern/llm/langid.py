"""Language identification by multilingual mixture inference over n-gram likelihoods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table

#: Byte n-grams of ORDER, hashed into BUCKETS; a language learns from about SAMPLE documents at most (whole texts).
ORDER, BUCKETS, SAMPLE = 4, 1 << 16, 3000
#: EM rounds, and what a further language must gain in log-likelihood, per logarithm of the words.
ROUNDS, PENALTY = 8, 8.0
UNKNOWN = "und"
#: Bytes of text handled at once.
CHUNK = 2 << 20

SCHEMA = "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())),
    ("shares", pa.list_(pa.float64())),
])
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    """Lower-cased letters, words parted by single spaces, one space before and ORDER - 1 after them."""
    return b" " + _NOT_LETTERS.sub(" ", text.lower()).strip().encode() + b" " * (ORDER - 1)


def grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte."""
    h = np.zeros(len(data) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        h = (h << np.uint64(8)) | data[k : len(data) - ORDER + 1 + k]
    return ((h * _MULTIPLIER) >> np.uint64(48)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities [bucket, language] from ``docs(doc_id, text, lang)``.

    Each language learns from a hash sample of about ``sample`` documents, all if it has fewer. The counts are summed
    per (language, bucket), map-side combined; at most BUCKETS rows per language come to the driver.
    """
    rows = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 20)) / float(1 << 20)
    some = rows.where(place < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros(BUCKETS, np.int64) for k in langs}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(normalise(text.as_py()), np.uint8).astype(np.uint64)
                if len(data) >= ORDER:
                    seen[lang] += np.bincount(grams(data), minlength=BUCKETS)
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    table = np.full((BUCKETS, len(langs)), 0.5)
    for r in some.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
        table[r.bucket, langs.index(r.lang)] += r.n
    return langs, np.log(table / table.sum(0))


def mixtures(like: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Share of each language in each document, 0 outside the selected set.

    like: [word, language] likelihoods scaled to a maximum of 1; starts: first word of each document. For the sets of
    the 1, 2, ... largest languages of the full mixture, expectation-maximisation fits the shares; the set with the
    largest log-likelihood less PENALTY * log(words) per further language wins.
    """
    n_docs, n_langs = len(starts), like.shape[1]
    sizes = np.diff(np.append(starts, len(like)))
    of = np.repeat(np.arange(n_docs), sizes)

    def fit(theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            post = like * theta[of]
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            theta = np.add.reduceat(post, starts) / sizes[:, None]
        total = np.add.reduceat(np.log(np.maximum((like * theta[of]).sum(1), 1e-300)), starts)
        return theta, total

    theta, gain = fit(np.full((n_docs, n_langs), 1 / max(n_langs, 1)), ROUNDS)
    place = np.argsort(np.argsort(-theta, 1, kind="stable"), 1, kind="stable")
    best, value = theta, gain - PENALTY * (n_langs - 1) * np.log(sizes + 1)
    for size in range(1, n_langs):
        some = np.where(place < size, np.maximum(theta, 1e-12), 0)
        some, gain = fit(some / some.sum(1, keepdims=True), ROUNDS // 2 if size > 1 else 1)
        now = gain - PENALTY * (size - 1) * np.log(sizes + 1)
        better = now >= value
        best, value = np.where(better[:, None], some, best), np.maximum(now, value)
    return best


def predict(texts: list[str | None], langs: list[str], table: np.ndarray) -> list[tuple]:
    """(language, score, languages, shares) of each text."""
    data = [normalise(t) if t and any(map(str.isalpha, t)) else b"" for t in texts]
    out: list[tuple] = [(UNKNOWN, 0.0, [], [])] * len(texts)
    live = [i for i, d in enumerate(data) if len(d) > ORDER] if langs else []
    if not live:
        return out
    joined = np.frombuffer(b"".join(data[i] for i in live) + b" " * ORDER, np.uint8).astype(np.uint64)
    words = np.flatnonzero((joined[:-1] == 32) & (joined[1:] != 32))  # each word from the space before it
    values = table[grams(joined)]
    values[(joined[: len(values)] == 32) & (joined[1 : len(values) + 1] == 32)] = 0  # between documents
    like = np.add.reduceat(values, words)
    like = np.exp(like - like.max(1, keepdims=True))
    ends = np.cumsum([len(data[i]) for i in live])
    starts = np.searchsorted(words, np.concatenate([[0], ends[:-1]]))
    for i, share in zip(live, mixtures(like, starts)):
        order = [j for j in np.argsort(-share, kind="stable") if share[j] > 0]
        out[i] = (langs[order[0]], float(min(1.0, share[order[0]])), [langs[j] for j in order], [float(share[j]) for j in order])
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Rows of ``SCHEMA``: the leading language of each ``docs(doc_id, text)``, its share as score, and the set.

    Only the text is used. Null text or text without a letter: ``und`` with score 0 and no languages; so is all text
    if nothing was learned. Long texts are whole: likelihoods are summed per word, in chunks of whole documents.
    Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    langs, table = model[0], model[1].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids, texts):
            rows = [(i, *p) for i, p in zip(ids, predict(texts, langs, table))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size > CHUNK:
                    yield emit(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield emit(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
