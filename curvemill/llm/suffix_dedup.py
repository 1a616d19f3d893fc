"""Substring deduplication over the whole corpus with an enhanced sparse suffix array.

A repeat of WINDOW bytes always holds an anchor (see ``_repeats``), so the suffix array is kept only at anchors: the
suffixes that start at the occurrences of one anchor form a contiguous slice of it, sorted here with their common
prefix lengths. A stack scan over these gives the tree of common-prefix intervals; the members of an interval are then
scanned by their left contexts in the same way, which tests left-extension diversity and yields maximal repeat groups
with all their occurrences, not only neighbours. In a group all but the earliest occurrence are covered.

Nulls and empty texts have no bytes and no repeats; texts shorter than the window stay whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curvemill.llm import _repeats
from curvemill.llm._common import mix, spread, steps, utf8, window_min

#: Bytes of a repeat, and of the gram that anchors it.
WINDOW, GRAM = 100, 36
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])


def byte_anchors(data: np.ndarray, offsets: np.ndarray) -> _repeats.Anchors:
    part = data[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    windows = np.maximum(np.diff(offsets) - (WINDOW - 1), 0)
    if len(part) < WINDOW:
        return _repeats.select_anchors(np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, windows, spread(starts, windows))
    n = len(part) - GRAM + 1
    eight = np.ndarray((len(part) - 7,), "<u8", buffer=np.ascontiguousarray(part), strides=(1,))
    grams = np.zeros(n, np.uint64)
    for at, factor in zip((0, 8, 16, 24, GRAM - 8), _FACTORS, strict=True):
        grams += eight[at : at + n] * factor
        grams ^= grams >> np.uint64(31)
    mix(grams)
    low = np.uint64(0xFFFFFFFF)
    least = (window_min((grams & ~low) | np.arange(n, dtype=np.uint64), WINDOW - GRAM + 1) & low).astype(np.int64)
    return _repeats.select_anchors(grams, least, starts, windows, spread(starts, windows))


def contexts(data: np.ndarray, offsets: np.ndarray, a: _repeats.Anchors) -> tuple[list, list, list]:
    """Of each anchor: bytes of its windows before it, number of its windows, and their bytes together."""
    at = offsets[a.doc] + a.lo
    text = data[offsets[0] : offsets[-1]].tobytes()
    n = a.hi - a.lo + 1
    return (a.pos - a.lo).tolist(), n.tolist(), [text[x:y] for x, y in zip((at - offsets[0]).tolist(), (at - offsets[0] + n + WINDOW - 1).tolist(), strict=True)]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x, y = a[:n], b[:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, length, length of the parent) of each common-prefix interval of a sorted array, children first; lcp[i] is between i and i + 1."""
    stack = [(0, 0)]  # length, leftmost member
    for i in range(1, len(lcp) + 2):
        length, left = (lcp[i - 1] if i <= len(lcp) else 0), i
        while stack[-1][0] > length:
            top, left = stack.pop()
            yield left, i, top, max(length, stack[-1][0])
        if stack[-1][0] < length:
            stack.append((length, left - (left == i)))


class Compare:
    """Groups of records (key, kind, doc_id, dkey, start, left, n, body) with one anchor."""

    @staticmethod
    def group(rows: list[tuple]) -> Iterator[tuple[tuple, int, int]]:
        """Covered windows (row, first start, count): the maximal repeats of at least WINDOW bytes, all occurrences but the earliest."""
        rights = [r[7][r[5] :] for r in rows]
        lefts = [r[7][: r[5]][::-1] for r in rows]
        order = sorted(range(len(rows)), key=rights.__getitem__)
        lcp = [common(rights[order[i]], rights[order[i + 1]]) for i in range(len(order) - 1)]
        for lo, hi, right, parent in intervals(lcp):
            if right < GRAM:
                continue
            # offsets (of the anchor in its window) that this interval adds: those that need more than the parent's length
            least, most = WINDOW - right, WINDOW - parent - 1 if parent >= GRAM else WINDOW
            members = sorted(order[lo:hi], key=lefts.__getitem__)
            left_lcp = [common(lefts[members[i]], lefts[members[i + 1]]) for i in range(len(members) - 1)]
            done: set[int] = set()
            tree = [*intervals(left_lcp), *([(0, len(members), 0, -1)] if least <= 0 else [])]
            for a, b, left, _ in tree:
                if left < least:
                    continue
                open_ = [m for m in members[a:b] if m not in done]
                first = min((rows[m][2], rows[m][4] + rows[m][5]) for m in open_)
                for m in open_:
                    row = rows[m]
                    if (row[2], row[4] + row[5]) > first:
                        done.add(m)
                        top = min(left, most, row[5])
                        if top >= least:
                            yield row, row[4] + row[5] - top, top - least + 1

    @staticmethod
    def places(row: tuple, at: int, n: int) -> Iterator[tuple[tuple, int, int]]:
        yield row, row[4] + at, n

    @staticmethod
    def single(row: tuple) -> Iterator[tuple]:
        """The windows of a record of a hot group, each dealt by its own digest."""
        for i in range(row[6]):
            digest = hashlib.blake2b(row[7][i : i + WINDOW], digest_size=16).digest()
            yield int.from_bytes(digest[:8], "little", signed=True), _repeats.WINDOW, row[2], row[3], row[4] + i, 0, 1, digest


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        ids, ranges = batch["doc_id"].to_pylist(), batch["ranges"].to_pylist()
        for i, j in steps(offsets, 4 << 20):
            rows = []
            for k in range(i, j):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                spans = _repeats.joined([(r["start"], r["start"] + r["n"] - 1 + WINDOW) for r in ranges[k] or () if r["doc_id"] == ids[k]])
                kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True)) if spans else text
                rows.append((ids[k], len(text), [{"start": a, "end": b} for a, b in spans], kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """Every document's bytes without those of repeated strings (kept), its length in bytes and the removed spans; see the module."""
    base, ranges = _repeats.repeated_ranges(documents, byte_anchors, contexts, Compare, strictly_smaller_doc=False)
    return _repeats.cut(base, ranges, _cut, SCHEMA)
