"""Chat formatting: offset-aligned masks (operator 10).

A conversation is rendered as a whole: for each turn its role, BREAK, its text,
BREAK. BREAK is the vocabulary's one control string, so the tokenizer always
cuts there and no token straddles a turn's edge. Inside roles and texts
backslashes are doubled and ``<|`` becomes ``<\\|``, which holds no control
string and is undone exactly. The whole rendering is encoded once, with
offsets; the sorted spans of the assistant texts meet the tokens' spans by
binary search, and a token that lies in one is in the loss mask.

Conversations are made by sorting within partitions, read as a stream: one
conversation is held at a time, whatever the number of its neighbours.

Defined results
* null text or role: empty; turns are ordered by turn (null first), role, text
* a null conv_id is a conversation of its own; repeated rows are turns of their own
* empty table: empty result; other columns are never read
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.common import small_batches
from lexiweave.llm.packing import load_tokenizer

BREAK = "<|endoftext|>"
LEARNED = "assistant"
SCHEMA = "conv_id bigint, n_turns bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = escape(role) + BREAK, escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, BREAK]
        at += len(head) + len(body) + len(BREAK)
    return "".join(out), spans


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each token lies in a span; spans are sorted and apart."""
    begins = [a for a, _ in spans]
    out = []
    for a, b in offsets:
        i = bisect.bisect_right(begins, a) - 1
        out.append(i >= 0 and a < b <= spans[i][1])
    return out


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    parts = formatted.split(BREAK)
    return [(unescape(parts[i]), unescape(parts[i + 1])) for i in range(0, len(parts) - 1, 2)]


def masked_text(formatted: str, starts, ends, mask) -> str:
    """All text under the mask, unescaped; tokens that share a character count it once."""
    out, upto = [], 0
    for a, b, on in zip(starts, ends, mask, strict=True):
        if on and b > upto:
            out.append(formatted[max(a, upto) : b])
            upto = b
    return unescape("".join(out))


def _formatter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path, control=True)
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])

        def row(key, turns):
            text, spans = render(turns)
            got = tokenizer.encode(text, add_special_tokens=False)
            return key, len(turns), text, got.ids, [a for a, _ in got.offsets], [b for _, b in got.offsets], loss_mask(got.offsets, spans)

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows), schema, strict=True)], schema=schema)

        now, turns, rows, size = (), [], [], 0
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (key,) != now:
                    if now:
                        rows.append(row(now[0], turns))
                        size += len(rows[-1][2])
                    now, turns = (key,), []
                    if size > 1_000_000:
                        yield flush(rows)
                        rows, size = [], 0
                turns.append((role or "", text or ""))
        if now:
            rows.append(row(now[0], turns))
        if rows:
            yield flush(rows)

    return run


def format_chats(turns: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, formatted, ids, starts, ends (token spans), mask."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatter(path or default_path()), SCHEMA)


def default_path() -> str:
    from lexiweave.llm.packing import default_path as found

    return found()
