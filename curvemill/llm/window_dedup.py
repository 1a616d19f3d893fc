"""Removal of windows of 50 words that an earlier document has, behind a count-min prefilter.

1. Texts are dealt into chunks of about CHUNK_BYTES by a hash of the row. Each chunk is a partition of the sketch: every
   window of a document sets a counter in each of DEPTH rows. The width follows the input (CELLS_PER_BYTE), so the whole
   sketch is never in one place: a chunk's counters are sparse and go, by ranges of counters, to the block that merges
   this range over all chunks.
2. A block adds up the chunks' counters and tells each chunk which of its own reach two or more. What a window's least
   counter says is never below the number of its occurrences, so a window that stays below two occurs once: nothing is
   lost. With w windows to width cells, one that occurs once passes with probability (1 - exp(-w / width)) ** DEPTH:
   0.014 for words of five letters and a blank, 0.08 if every word had one letter, at any size of the input.
3. The second pass groups exactly what is left. A chunk settles its own repeats, then sends each remaining window once
   for the earliest document that it has it from, in runs of windows that share an anchor (see ``_repeats``; equal
   windows have equal anchors), as fingerprints of 128 bits from two independent hashes of every word.

A worker lives on from stage to stage, so after each chunk and block it gives the memory of its arrays back.

Nulls and empty texts have no words; documents under 50 words stay whole, as those without doc_id do; rows repeated get
equal results and meet in one chunk; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm import _repeats
from curvemill.llm._common import grams, rest, spread, steps, utf8, window_min, words_of

#: Words of a window, and of the gram that anchors it.
WINDOW, GRAM = 50, 8
#: Rows of the sketch, counters in a row for each byte of text (at least), bytes of text in a chunk.
DEPTH, CELLS_PER_BYTE, CHUNK_BYTES = 2, 1.4, 8 << 20
#: Counters that a block merges (more, where there would be more than MAX_BLOCKS blocks).
BLOCK_CELLS, MAX_BLOCKS = 1 << 23, 1 << 18
_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
_MESSAGE = pa.schema([("block", pa.int32()), ("chunk", pa.int64()), ("row", pa.int32()), ("wide", pa.bool_()), ("cells", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("block", pa.int32()), ("twice", pa.binary())])


@dataclass(frozen=True)
class Sketch:
    """Shape of the sketch: chunks of text, bits of a counter's number in a row, and of the number of its block."""

    chunks: int
    bits: int
    block_bits: int

    @classmethod
    def of(cls, n_bytes: int) -> Sketch:
        bits = max(12, int(np.ceil(np.log2(max(1, n_bytes) * CELLS_PER_BYTE))))
        blocks = min(MAX_BLOCKS, max(1, (1 << bits) // BLOCK_CELLS))
        return cls(n_bytes // CHUNK_BYTES + 1, bits, blocks.bit_length() - 1)

    def cells(self, prints: np.ndarray, row: int) -> np.ndarray:
        """Counters of windows in a row."""
        return ((prints * _FACTORS[row]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def blocks(self, cells: np.ndarray) -> np.ndarray:
        return cells >> (self.bits - self.block_bits)

    def within(self, cells: np.ndarray) -> np.ndarray:
        return cells & ((1 << (self.bits - self.block_bits)) - 1)


@dataclass(frozen=True)
class Windows:
    """The windows of some documents: number of the document, number of the first word there, place in the step's words; the words' hashes."""

    doc: np.ndarray
    start: np.ndarray
    place: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, streams: int) -> Windows:
        hashes, _, _, first = words_of(data, offsets, lower=False, streams=streams)
        count = np.maximum(np.diff(first) - (WINDOW - 1), 0)
        place = spread(first[:-1], count)
        doc = np.repeat(np.arange(len(count)), count)
        return cls(doc, place - first[doc], place, first, hashes)

    def prints(self, row: int = 0) -> np.ndarray:
        return grams(self.hashes[row] if self.hashes.ndim == 2 else self.hashes, WINDOW)[self.place]

    def anchors(self) -> np.ndarray:
        """The hash of each window's anchor."""
        g = grams(self.hashes[0], GRAM)
        if not len(self.place):
            return np.zeros(0, np.int64)
        low = np.uint64(0xFFFFFFFF)
        least = (window_min((g & ~low) | np.arange(len(g), dtype=np.uint64), WINDOW - GRAM + 1) & low).astype(np.int64)
        return g[least[self.place]].view(np.int64)


def _known(table: pa.Table | pa.RecordBatch) -> pa.Table | pa.RecordBatch:
    return table.filter(table["doc_id"].is_valid())


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    return pa.concat_arrays(table[name].chunks) if table[name].num_chunks else pa.array([], table[name].type)


def _equal(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal values."""
    cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return zip(cut[:-1], cut[1:], strict=True) if len(values) else iter(())


def packed(cells: np.ndarray) -> tuple[bool, bytes]:
    """Ascending numbers as bytes: gaps of 16 bits (65535: nothing here, go on), or 32 bits each where gaps are wide."""
    if len(cells) and int(cells[-1]) > 8192 * len(cells):
        return True, cells.astype("<u4").tobytes()
    gaps = np.diff(cells, prepend=0)
    skips = gaps // 65535
    out = np.full(len(cells) + int(skips.sum()), 65535, "<u2")
    out[np.arange(len(cells)) + np.cumsum(skips)] = gaps % 65535
    return False, out.tobytes()


def unpacked(wide: bool, data: bytes) -> np.ndarray:
    if wide:
        return np.frombuffer(data, "<u4").astype(np.int64)
    gaps = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(gaps)[gaps < 65535]


def _partition_sketch(sketch: Sketch) -> Callable:
    def messages(chunk: int, parts: Iterator[pa.RecordBatch]) -> list[tuple]:
        found, out = [np.zeros(0, np.uint64)], []
        for part in parts:
            data, offsets = utf8(_known(part)["text"])
            found += [Windows.of(data, offsets[i : j + 1], 1).prints() for i, j in steps(offsets)]
        prints = np.concatenate(found)
        del found
        for row in range(DEPTH):
            cells = np.unique(sketch.cells(prints, row))
            block = sketch.blocks(cells)
            for a, b in _equal(block):
                out.append((int(block[a]), chunk, row, *packed(sketch.within(cells[a:b]))))
        return out

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(messages(key[0].as_py(), parts), _MESSAGE)
        rest()

    return run


def _sent(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)


def _merge(sketch: Sketch) -> Callable:
    def replies(block: int, parts: Iterator[pa.RecordBatch]) -> list[tuple]:
        messages = []
        total = np.zeros((DEPTH, 1 << (sketch.bits - sketch.block_bits)), np.uint8)
        for part in parts:
            for message in zip(*(part[c].to_pylist() for c in ("chunk", "row", "wide", "cells")), strict=True):
                cells = unpacked(*message[2:])
                total[message[1], cells] = np.minimum(total[message[1], cells] + 1, 2)  # a chunk has a cell once
                messages.append(message)
        out = []
        for chunk, row, wide, data in messages:
            twice = total[row, unpacked(wide, data)] > 1
            if twice.any():
                out.append((chunk, row, block, np.packbits(twice).tobytes()))
        return out

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(replies(key[0].as_py(), parts), _REPLY)
        rest()

    return run


def likely(sketch: Sketch, prints: np.ndarray, replies: dict[tuple[int, int], bytes]) -> np.ndarray:
    """Which windows the merged sketch, and the chunk's own counters, estimate at two or more."""
    keep = np.ones(len(prints), bool)
    for row in range(DEPTH):
        cells, at, count = np.unique(sketch.cells(prints, row), return_inverse=True, return_counts=True)
        block = sketch.blocks(cells)
        twice = count > 1
        for a, b in _equal(block):
            if bits := replies.get((row, int(block[a]))):
                twice[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).view(bool)
        keep &= twice[at]
    return keep


def _candidates(sketch: Sketch) -> Callable:
    def records(texts: pa.Table, replies: pa.Table) -> pa.Table:
        known = _known(texts)
        data, offsets = utf8(_column(known, "text"))
        ids, dkeys = _column(known, "doc_id").to_numpy(), _column(known, "dkey").to_numpy()
        told = dict(zip(zip(replies["row"].to_pylist(), replies["block"].to_pylist(), strict=True), replies["twice"].to_pylist(), strict=True))
        parts = [Windows.of(data, offsets[i : j + 1], 1).prints() for i, j in steps(offsets)]
        keep, at, found = likely(sketch, np.concatenate([*parts, np.zeros(0, np.uint64)]), told), 0, []
        for (i, j), part in zip(steps(offsets), parts, strict=True):
            mine = np.flatnonzero(keep[at : at + len(part)])
            at += len(part)
            if len(mine):
                w = Windows.of(data, offsets[i : j + 1], 2)
                found.append((w.doc[mine] + i, w.start[mine], w.prints(0)[mine], w.prints(1)[mine], w.anchors()[mine]))
        rows = _records(ids, dkeys, *(np.concatenate(x) for x in zip(*found, strict=True))) if found else []
        return pa.Table.from_batches(list(_repeats.record_batches(rows)), schema=_repeats.RECORD_SCHEMA)

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        found = records(texts, replies)
        rest()
        return found

    return run


def _records(ids: np.ndarray, dkeys: np.ndarray, doc: np.ndarray, start: np.ndarray, p0: np.ndarray, p1: np.ndarray, anchor: np.ndarray) -> list[tuple]:
    """A chunk's candidates: ranges that an earlier document of the chunk covers, and what has to be compared with other chunks."""
    order = np.lexsort((start, dkeys[doc], ids[doc], p1, p0))
    s0, s1, sid, skey = p0[order], p1[order], ids[doc][order], dkeys[doc][order]
    new = np.concatenate([[True], (s0[1:] != s0[:-1]) | (s1[1:] != s1[:-1])])
    group = np.cumsum(new) - 1
    later = sid > sid[new][group]  # a smaller doc_id of this chunk has the same window
    again = ~new & np.concatenate([[False], skey[1:] == skey[:-1]]) & ~later  # the same document once more
    covered, repeated = np.zeros(len(doc), bool), np.zeros(len(doc), np.int64)
    covered[order[later]] = True
    leader = np.flatnonzero(~again)[np.cumsum(~again) - 1]  # the first of each document's equal windows
    repeated[order] = np.bincount(leader, minlength=len(doc))[leader]
    # runs of consecutive windows of one document
    lonely = ~covered & (repeated > 1)
    step = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (covered[1:] != covered[:-1]) | lonely[1:] | lonely[:-1] | (~covered[1:] & (anchor[1:] != anchor[:-1]))
    begin = np.flatnonzero(np.concatenate([[True], step]))
    both, out = np.stack([p0, p1], axis=1), []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(doc)], strict=True):
        name, dkey, at = int(ids[doc[a]]), int(dkeys[doc[a]]), int(start[a])
        if covered[a]:
            out.append((dkey, _repeats.DECIDED, name, dkey, at, 0, b - a, None))
        elif not lonely[a]:
            out.append((int(anchor[a]), _repeats.GROUPED, name, dkey, at, 0, b - a, both[a:b].tobytes()))
    # a window that its document has several times is sent once, with its other places
    heads = np.flatnonzero(~again & ~later & (np.bincount(leader, minlength=len(doc)) > 1))
    for h in heads.tolist():
        n = int(repeated[order[h]])
        k, more = order[h], start[order[h + 1 : h + n]].astype("<i4")
        out.append((int(anchor[k]), _repeats.GROUPED, int(sid[h]), int(skey[h]), int(start[k]), n - 1, 1, both[k].tobytes() + more.tobytes()))
    return out


class Compare:
    """Groups of records (key, kind, doc_id, dkey, start, left, n, body) with one anchor; left counts further places, which follow the fingerprints."""

    @staticmethod
    def group(rows: list[tuple]) -> Iterator[tuple[tuple, int, int]]:
        """Covered windows (row, first start, count) of records sorted by document."""
        seen: dict[bytes, int] = {}
        for row in rows:
            body, doc, begun = row[7], row[2], None
            for i in range(row[6]):
                if seen.setdefault(body[16 * i : 16 * i + 16], doc) < doc:
                    begun = i if begun is None else begun
                elif begun is not None:
                    yield row, row[4] + begun, i - begun
                    begun = None
            if begun is not None:
                yield from Compare.places(row, begun, row[6] - begun)

    @staticmethod
    def places(row: tuple, at: int, n: int) -> Iterator[tuple[tuple, int, int]]:
        """n windows of a row from its window at on, wherever its document has them."""
        yield row, row[4] + at, n
        if row[5]:
            for start in np.frombuffer(row[7][16 * row[6] :], "<i4").tolist():
                yield row, start, 1

    @staticmethod
    def single(row: tuple) -> Iterator[tuple]:
        more = row[7][16 * row[6] :]
        for i in range(row[6]):
            one = row[7][16 * i : 16 * i + 16]
            yield int.from_bytes(one[:8], "little", signed=True), _repeats.WINDOW, row[2], row[3], row[4] + i, row[5], 1, one + more


def _cut(texts: pa.Table, ranges: pa.Table) -> pa.Table:
    out = _kept(texts, ranges)
    rest()
    return out


def _kept(texts: pa.Table, ranges: pa.Table) -> pa.Table:
    data, offsets = utf8(_column(texts, "text"))
    ids, dkeys = texts["doc_id"].to_pylist(), texts["dkey"].to_pylist()
    spans: dict[tuple, list] = {}
    for dkey, doc, start, n in zip(*(ranges[c].to_pylist() for c in ("dkey", "doc_id", "start", "n")), strict=True):
        spans.setdefault((dkey, doc), []).append((start, start + n - 1 + WINDOW))
    rows = []
    for k in range(len(ids)):
        words = data[offsets[k] : offsets[k + 1]].tobytes().split()
        mine = _repeats.joined(spans.get((dkeys[k], ids[k]), []))
        kept = [w for a, b in zip([0, *(e for _, e in mine)], [*(s for s, _ in mine), len(words)], strict=True) for w in words[a:b]] if mine else words
        rows.append((ids[k], len(words), len(words) - len(kept), b" ".join(kept).decode()))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def dedup_windows(documents: DataFrame) -> DataFrame:
    """Every document's words that no window of an earlier document covers (kept, joined by one space), and counts."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = Sketch.of(int(size))
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chunk = F.pmod("dkey", F.lit(sketch.chunks))
    chunks = base.withColumn("dkey", F.xxhash64("doc_id", "text")).withColumn("chunk", chunk).groupBy("chunk")  # one exchange, reused

    sent = chunks.applyInArrow(_partition_sketch(sketch), "block int, chunk long, row int, wide boolean, cells binary")
    replies = sent.groupBy("block").applyInArrow(_merge(sketch), "chunk long, row int, block int, twice binary")
    rows = chunks.cogroup(replies.groupBy("chunk")).applyInArrow(_candidates(sketch), _repeats.RECORD)
    ranges = _repeats.compared(rows, Compare, strictly_smaller_doc=True).select("dkey", "doc_id", "start", "n", chunk.alias("chunk"))
    return chunks.cogroup(ranges.groupBy("chunk")).applyInArrow(_cut, SCHEMA)
