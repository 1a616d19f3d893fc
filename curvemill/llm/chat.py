r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns (role, text) to a string. The operator knows nothing of its marks: it
renders every prefix of a conversation, and what an output adds to the one before is the new turn's span. A template
whose output for a prefix isn't the beginning of the next has rewritten history; the conversation is then flagged and
its spans are null. The loss mask covers assistant texts: their place in a span is found by rendering the turn with two
probe texts that have no character in common and comparing the outputs from both sides.

The default template marks turns with control strings and escapes those inside texts: between "<" and "|", which starts
every control string, it puts one more backslash than there is, so no text can end or begin a turn, and reading back
takes one off. Roles have their backslashes doubled and line ends written as \n first.

Turns are ordered by turn, then role and text; repeated rows are turns of their own; null texts are empty, null roles
"user"; rows without conv_id form one conversation. Rows stream in the order of their conversation, so that a task holds
one conversation at a time. Prefixes make a conversation's time its turns times its length: one of 2,000 turns of 100
characters takes about 1 s. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
START, END = "<|im_start|>", "<|im_end|>"
SCHEMA = "conv_id long, formatted string, spans array<struct<start:int,end:int>>, loss array<struct<start:int,end:int>>, rewrites boolean"
_OUT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("rewrites", pa.bool_())])


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@lru_cache(4096)
def _marked(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def chatml(turns: Turns) -> str:
    return "".join(_marked(role, text) for role, text in turns)


def read_back(formatted: str) -> Turns:
    """The turns of a chatml output."""
    parts = formatted.split(START)[1:]
    turns = (part[: -len(END) - 1].split("\n", 1) for part in parts)
    return [(unescape_role(role), unescape(text)) for role, text in turns]


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b[: len(a)]:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def render(turns: Turns, template: Callable[[Turns], str], learn: str = "assistant") -> tuple[str, list[tuple[int, int]] | None, list[tuple[int, int]] | None]:
    """Output, each turn's span, and the spans of the texts of role learn in the output; None for both if the template rewrites history."""
    before, spans, loss = template([]), [], []
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            return template(turns), None, None
        if role == learn:
            # two probes with nothing in common show where the frame ends and where it goes on
            one, other = template([*turns[:k], (role, "0")]), template([*turns[:k], (role, "1")])
            start, tail = _shared(one, other), _shared(one[::-1], other[::-1])
            loss.append((start, max(start, len(now) - tail)))
        spans.append((len(before), len(now)))
        before = now
    return before, spans, loss


def _rendered(template: Callable[[Turns], str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, out, size = "none yet", [], [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != key:
                    if turns:
                        out.append((key, *_row(turns, template)))
                        size += len(out[-1][1])
                    key, turns = conv, []
                    if len(out) >= 2000 or size > 4 << 20:
                        yield _batch(out)
                        out, size = [], 0
                turns.append((role, text))
        if turns:
            out.append((key, *_row(turns, template)))
        if out:
            yield _batch(out)

    return run


def _row(turns: Turns, template: Callable[[Turns], str]) -> tuple:
    formatted, spans, loss = render(turns, template)
    pack = lambda x: None if x is None else [{"start": a, "end": b} for a, b in x]
    return formatted, pack(spans), pack(loss), spans is None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def format_chats(conversations: DataFrame, template: Callable[[Turns], str] = chatml) -> DataFrame:
    """A row for each conversation: its output, the spans of turns and of what is learnt (code points), and whether the template rewrote history."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_rendered(template), SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What chatml outputs say when read back: turns and their hash, the learnt text and its hash, the length."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns = read_back(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss or ())
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, schema)
