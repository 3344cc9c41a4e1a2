"""Sum-of-squares online packing of token sequences into fixed windows."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table

WINDOW = 1024
#: Words kept in a worker's cache of encoded words; it is emptied when full.
CACHE_WORDS = 400_000
END_ID = 0

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary"
)
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("token_ids", pa.binary()),
])


class WordEncoder:
    """Byte-level BPE ids of a text, as little-endian unsigned 32-bit integers.

    The pre-tokenizer never joins characters over a single space that stands between two other characters that are
    not white space, so the words cut there are encoded by themselves and kept in a bounded cache. A text whose
    words touch other white space is cut only where that rule holds. The ids equal those of the whole text.
    Strings of the vocabulary's added tokens get their own ids, and the text between them is encoded by itself.
    """

    def __init__(self, vocabulary: str):
        import json
        import re

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(f)["added_tokens"]}
        self.added_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        encoder = self

        class Cache(dict):
            def __missing__(self, word: str) -> bytes | None:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                clean = word and not word[0].isspace() and not word[-1].isspace()
                self[word] = out = encoder.plain(" " + word) if clean else None
                return out

        self.cache = Cache()

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added.get(part) or self.ordinary(part) for part in self.added_cut.split(text) if part)
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        words = text.split(" ")
        first = words[0]
        if first and not first[0].isspace() and not first[-1].isspace():
            try:
                return self.plain(first) + b"".join(map(self.cache.__getitem__, words[1:]))
            except TypeError:
                pass
        parts = self.cut.split(text)
        return self.plain(parts[0]) + b"".join(
            self.cache[p] or self.plain(" " + p) for p in parts[1:]
        )


class SumOfSquares:
    """Open windows by fill level; ``levels[h]`` counts the windows filled to ``h``, 0 < h < window."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(window + 1)]

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, piece: tuple) -> list[tuple[int, list]]:
        """Puts ``piece`` (doc_id, start, length, ...) where the sum of squared level counts grows least.

        Ties go to the fuller window. Returns the window if that filled it.
        """
        size, n = piece[2], self.levels
        here, there = n[1 : self.window + 1 - size], n[1 + size : self.window + 1]
        best, cost = 0, 2 * int(n[size]) + 1
        if len(here):
            change = 2 * (there - here + 1)
            change[-1] = 1 - 2 * here[-1]
            change[here == 0] = np.iinfo(np.int64).max
            at = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= cost:
                best = at + 1
        if best:
            sequence, pieces = self.open[best].pop()
            n[best] -= 1
        else:
            sequence, pieces = self.new_id(), []
        pieces.append(piece)
        if best + size == self.window:
            return [(sequence, pieces)]
        n[best + size] += 1
        self.open[best + size].append((sequence, pieces))
        return []

    def close(self) -> list[tuple[int, list]]:
        """Cuts the pieces of the emptiest open windows into the gaps of the fullest; what is left when one open
        window remains is cut into windows whose fills are powers of two, which need no padding."""
        left = [w for level in self.open for w in level]
        done, low, high = [], 0, len(left) - 1
        fill = [sum(p[2] for p in w[1]) for w in left]
        while low < high:
            gap = self.window - fill[high]
            doc, start, length, *rest = left[low][1].pop()
            take = min(gap, length)
            if take < length:
                left[low][1].append((doc, start, length - take, *rest))
            left[high][1].append((doc, start + length - take, take, *rest))
            fill[low] -= take
            fill[high] += take
            low += fill[low] == 0
            if fill[high] == self.window:
                done.append(left[high])
                high -= 1
        if low == high and fill[low]:
            pieces, total = left[low][1], fill[low]
            for bit in range(total.bit_length() - 1, -1, -1):
                if total >> bit & 1:
                    room, now = 1 << bit, []
                    while room:
                        doc, start, length, *rest = pieces.pop(0)
                        take = min(room, length)
                        now.append((doc, start, take, *rest))
                        if take < length:
                            pieces.insert(0, (doc, start + take, length - take, *rest))
                        room -= take
                    done.append((self.new_id(), now))
        return done


def pack_rows(documents: Iterator[tuple[int | None, bytes]], window: int, first_id: int) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for (doc_id, little-endian ids) pairs; every id lies in exactly one piece."""
    packer = SumOfSquares(window, first_id)

    def rows(windows: list[tuple[int, list]]) -> Iterator[tuple]:
        for sequence, pieces in windows:
            at = 0
            for doc, start, length, total, ids in pieces:
                yield doc, start, length, total, sequence, at, ids[4 * start : 4 * (start + length)]
                at += length

    for doc, ids in documents:
        total = len(ids) // 4
        whole = total - total % window
        for start in range(0, whole, window):
            yield from rows([(packer.new_id(), [(doc, start, window, total, ids)])])
        if whole < total:
            yield from rows(packer.place((doc, whole, total - whole, total, ids)))
    yield from rows(packer.close())


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Packs every document of ``docs(doc_id, text)`` into sequences of at most ``window`` tokens.

    A document is the byte-level BPE ids of its text and an end id 0. Whole windows of a long document are sequences
    of their own; the rest is placed by sum-of-squares, each input partition with its own level array, so there is no
    shuffle and a lost task is packed again to the same ids. A partition's open windows are cut together at its end
    and leave no padding. Returns rows of ``SCHEMA``: ``offset`` is gapless from 0 in each sequence and ``token_ids``
    holds the piece's ids as little-endian unsigned 32-bit integers.

    Null and empty text: the end id alone. A null doc_id is kept. Repeated rows are packed as often as they occur.
    An empty table gives no rows. Other columns are not read. ``vocabulary`` is a rank file of the tokenizer.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = WordEncoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()

        def documents():
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for doc, text in zip(ids, texts):
                    yield doc, encode(text.as_py() or "") + end

        out, size = [], 0
        for row in pack_rows(documents(), window, TaskContext.get().partitionId() << 40):
            out.append(row)
            size += 64 + len(row[-1])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
