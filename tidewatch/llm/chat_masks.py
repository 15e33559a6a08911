"""Chat formatting with offset-aligned loss masks.

A conversation is rendered with marks that are tokens of their own, encoded with offsets, and the sorted spans
of its assistant turns are intersected with the sorted token spans by binary search. Since a mark is never
part of another token, a conversation may be cut between turns into blocks that are encoded one by one: the
tokens are those of the whole. Long conversations thus spread over tasks and never stand in memory whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import shared

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
BLOCKS = (
    "conv_id bigint, block bigint, piece bigint, formatted string, ids array<int>, "
    "masks array<struct<first_token:bigint,last_token:bigint,start:bigint,stop:bigint>>, n_turns bigint"
)
#: Turns of a block, by turn number, and characters after which a block's next piece begins.
BLOCK_TURNS, PIECE_CHARS = 256, 1_000_000

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escaped(text: str) -> str:
    """The text with a backslash more in each "<|", so that no mark stands in it."""
    return _OPEN.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the spans of the texts of assistant turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escaped(role)}{BODY}", escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}")
        at += len(parts[-1])
    return "".join(parts), spans


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [tuple(unescaped(x) for x in turn.split(BODY, 1)) for turn in
            (t.removesuffix(END) for t in formatted.split(TURN)[1:])]


def token_masks(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """For each span that is not empty: the tokens that overlap it (first, one past the last) and its characters."""
    if not spans or not len(offsets):
        return []
    starts, stops = np.array(spans).T
    first = np.searchsorted(offsets[:, 1], starts, side="right")
    last = np.searchsorted(offsets[:, 0], stops, side="left")
    return [{"first_token": int(f), "last_token": int(t), "start": int(max(a, offsets[f, 0])),
             "stop": int(min(b, offsets[t - 1, 1]))} for f, t, a, b in zip(first, last, starts, stops) if a < b]


def mark_tokenizer(path: str):
    """The tokenizer with the three marks as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    # offsets of a token cover its blanks too
    tokenizer.post_processor = ByteLevel(trim_offsets=False)
    tokenizer.add_tokens([AddedToken(m, normalized=False, special=False) for m in (TURN, BODY, END)])
    return tokenizer


def formatted_blocks(turns: DataFrame, tokenizer_path: str, *, conv_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted pieces of all conversations with token ids and loss masks, for writing.

    conv_id, block and piece order the pieces; a conversation of common size is one piece. Turns are ordered
    by number, then role and text; null roles and texts are empty, a null turn number comes first, a null
    conversation is one of its own. Masks count tokens and characters within the piece. An empty table gives
    no rows; other columns of turns are ignored.
    """
    shared.prepare(turns.sparkSession)
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.floor(F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)) / BLOCK_TURNS).alias("block"),
        shared.text_or_empty(role_col).alias("role"), shared.text_or_empty(text_col).alias("text"))
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    schema = shared.arrow_schema(BLOCKS)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.kept("chat_masks", tokenizer_path, lambda: mark_tokenizer(tokenizer_path))
        key, piece, held, chars = None, 0, [], 0

        def done() -> dict:
            text, spans = rendered(held)
            got = tokenizer.encode(text, add_special_tokens=False)
            return {"conv_id": key[0], "block": key[1], "piece": piece, "formatted": text, "ids": got.ids,
                    "masks": token_masks(np.array(got.offsets).reshape(-1, 2), spans), "n_turns": len(held)}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = (row["conv_id"], row["block"])
                if held and (own != key or chars >= PIECE_CHARS):
                    out.append(done())
                    piece, held, chars = piece + 1, [], 0
                if own != key:
                    key, piece = own, 0
                held.append((row["role"], row["text"]))
                chars += len(row["text"]) + len(row["role"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([done()], schema)

    return dealt.mapInArrow(form, BLOCKS)


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_tokens bigint, loss_tokens bigint"
)


def conversation_digests(blocks: DataFrame) -> DataFrame:
    """One row per conversation of written blocks: digests of its turns and of the text under its loss mask.

    The pieces of a conversation stream through one task in order, which a digest of all of it asks for; only
    one piece is held at a time.
    """
    shared.prepare(blocks.sparkSession)
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")

    schema = shared.arrow_schema(DIGESTS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def done() -> dict:
            return state["sums"] | {"turns_sha256": state["turns"].hexdigest(), "loss_sha256": state["loss"].hexdigest()}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != state["sums"]["conv_id"]:
                    if state is not None:
                        out.append(done())
                    state = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "sums": {
                        "conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0,
                        "n_tokens": 0, "loss_tokens": 0}}
                sums = state["sums"]
                for role, text in parsed(row["formatted"]):
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    sums["n_turns"] += 1
                for mask in row["masks"]:
                    text = unescaped(row["formatted"][mask["start"]:mask["stop"]])
                    state["loss"].update(text.encode())
                    sums["loss_chars"] += len(text)
                    sums["loss_tokens"] += mask["last_token"] - mask["first_token"]
                sums["formatted_chars"] += len(row["formatted"])
                sums["n_tokens"] += len(row["ids"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    return dealt.mapInArrow(digest, DIGESTS)
