"""Chat formatting with a loss mask aligned to token offsets."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table

#: A turn is TURN role TEXT text END. They are added to the tokenizer, so that no token reaches over one of them.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED = "assistant"

SCHEMA = (
    "conv_id long, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>,"
    " loss_tokens array<boolean>"
)
_ints = pa.list_(pa.int32())
ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("token_ids", _ints), ("token_starts", _ints),
    ("token_ends", _ints), ("loss_tokens", pa.list_(pa.bool_())),
])


def escape(text: str) -> str:
    r"""Doubles every backslash and breaks every ``<|`` into ``<\|``: no control string is left, and it can be undone."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the sorted code point spans of the texts to train on."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        if role == TRAINED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, text = turn.partition(TEXT)
        out.append((unescape(role), unescape(text.removesuffix(END))))
    return out


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """True for each token inside a span; both lists are sorted, each span's tokens are found by binary search."""
    starts, out = [a for a, _ in offsets], [False] * len(offsets)
    for a, b in spans:
        i = bisect_left(starts, a)
        for j in range(i, bisect_left(starts, b)):
            out[j] = offsets[j][1] <= b
    return out


def masked_text(formatted: str, starts: list[int], ends: list[int], loss: list[bool]) -> list[str]:
    """The runs of text under the mask; tokens that share a character (parts of its bytes) count it once."""
    runs: list[list[int]] = []
    for a, b, on in zip(starts, ends, loss):
        if on:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
    return [formatted[a:b] for a, b in runs]


def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_tokens([AddedToken(x, normalized=False, special=False) for x in (TURN, TEXT, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.encode_special_tokens = True
    return t


def format_conversations(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)``, of ``SCHEMA``.

    Each conversation is rendered whole, encoded once with offsets, and a token is under the loss mask if it lies in
    the span of an assistant's text. Turns are ordered by turn, then role and text; a conversation's rows meet in one
    row, which is what the result is made of. Null role or text: empty. Null conv_id: one conversation. Repeated
    rows are turns of their own. An empty table gives no rows. Other columns are not read.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(at, 256).to_pylist():
                    formatted, spans = render([(t["role"], t["text"]) for t in row["turns"]])
                    e = encoder.encode(formatted, add_special_tokens=False)
                    starts, ends = [a for a, _ in e.offsets], [b for _, b in e.offsets]
                    out.append((row["conv_id"], len(row["turns"]), formatted, e.ids, starts, ends, mask(e.offsets, spans)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)

    return whole.mapInArrow(run, SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def digest(formatted: DataFrame) -> DataFrame:
    """Reads turns and masked text back from the formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"])
                loss = "".join(map(unescape, masked_text(r["formatted"], r["token_starts"], r["token_ends"], r["loss_tokens"])))
                out.append((
                    r["conv_id"], len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"]),
                ))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), DIGEST_ARROW)], schema=DIGEST_ARROW)

    return formatted.mapInArrow(run, DIGEST)


PROBE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(PROBE).alias("text"),
    )
    return digest(format_conversations(rows.unionByName(probe)))
