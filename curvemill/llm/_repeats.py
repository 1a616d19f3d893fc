"""Whole-corpus search for windows (of bytes or words) that occur more than once, without shipping every window.

A window's *anchor* is the gram with the least hash among the grams that it holds (winnowing). The choice depends on
the window's content alone, so equal windows have equal anchors at equal offsets, and only one gram in about thirty
is the anchor of anything. Only anchors are counted over the corpus; only windows of anchors that occur at least
twice are compared. Nothing is lost: a repeated window has a repeated anchor.

Steps, one lazy plan (the exchange of the texts by document is one, reused):
 1. texts are dealt by document; each batch sends every distinct anchor once to the anchor's bucket. An anchor that
    the batch has twice needs no answer, so a very common one costs a record per batch;
 2. anchors that occur twice or more go back to their documents, which send the windows around them;
 3. these are sorted by anchor and compared as a stream (``compare``); a group of more than HOT records isn't held: its
    windows are dealt anew by their own digests and compared as a second stream, which holds one key at a time;
 4. covered ranges go back to their documents, are merged, and the texts are cut.

Records of documents with a null doc_id take no part; those texts stay whole. Rows with equal doc_id and text get
equal results; of two windows with equal doc_id and start neither is earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import steps, utf8

#: Records of one anchor that a task holds at once; what goes beyond is compared window by window.
HOT = 20_000
SALTS = 64
#: Bytes of text whose anchors a bucket counts.
BUCKET_BYTES = 8 << 20
DECIDED, GROUPED, WINDOW = 0, 1, 2
RECORD = "key long, kind int, doc_id long, dkey long, start int, left int, n int, body binary"
RECORD_SCHEMA = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("dkey", pa.int64()), ("start", pa.int32()), ("left", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
_SENT = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("dkeys", pa.binary()), ("pos", pa.binary())])
_FLAGS = pa.schema([("dkey", pa.int64()), ("pos", pa.int32())])


@dataclass(frozen=True)
class Anchors:
    """Anchors of a step's documents: number of the document, place and hash of the gram, first and last window start; places count from the document's start."""

    doc: np.ndarray
    pos: np.ndarray
    hash: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def select_anchors(grams: np.ndarray, least: np.ndarray, starts: np.ndarray, windows: np.ndarray, places: np.ndarray) -> Anchors:
    """grams: hash of the gram at each place; least: for each window start the place of its least gram; starts: a document's first place; windows: how many windows each document has; places: all their starts."""
    doc = np.repeat(np.arange(len(starts)), windows)
    at = least[places]
    if not len(at):
        none = np.zeros(0, np.int64)
        return Anchors(none, none, np.zeros(0, np.int64), none, none)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    end = np.concatenate([new[1:], [len(at)]]) - 1
    doc, q = doc[new], at[new]
    return Anchors(doc, q - starts[doc], grams[q].view(np.int64), places[new] - starts[doc], places[end] - starts[doc])


def repeated_ranges(documents: DataFrame, anchors: Callable, records: Callable, compare: Callable, strictly_smaller_doc: bool) -> tuple[DataFrame, DataFrame]:
    """The texts dealt by document (doc_id, text, dkey) and the covered ranges (dkey, ranges: array of doc_id, start, n).

    anchors(data, offsets) gives Anchors of a step; records(data, offsets, anchors) gives (left, n windows, body) of each;
    compare(rows) yields (row, start, n windows) of covered windows of a group sorted by doc_id and start.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size) // BUCKET_BYTES + 1
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("dkey", F.xxhash64("doc_id", "text")).repartition("dkey")

    sent = base.mapInArrow(_send(anchors, buckets), "bucket int, hashes binary, counts binary, dkeys binary, pos binary")
    flags = sent.groupBy("bucket").applyInArrow(_flag, "dkey long, pos int").groupBy("dkey").agg(F.collect_list("pos").alias("pos"))
    rows = base.join(flags, "dkey").select("doc_id", "text", "dkey", "pos").mapInArrow(_windows(anchors, records, strictly_smaller_doc), RECORD)
    rows = compared(rows, compare, strictly_smaller_doc)
    return base, rows.groupBy("dkey").agg(F.collect_list(F.struct("doc_id", "start", "n")).alias("ranges"))


def compared(rows: DataFrame, compare: Callable, strictly_smaller_doc: bool) -> DataFrame:
    """Records to ranges that are covered (kind DECIDED).

    Groups are compared first. Windows of hot groups, if there are any, are dealt by their digest and a salt, where all
    but the first are settled; the firsts of the salts meet at last, so no task gets more than SALTS rows of one digest
    and 1 / SALTS of its occurrences.
    """
    salt = F.pmod(F.xxhash64("dkey", F.lit(3)), F.lit(SALTS))
    for at, last in ((["key"], False), (["key", salt], False), (["key"], True)):
        rows = rows.repartition(*at).sortWithinPartitions("key", "doc_id", "start").mapInArrow(_compared(compare, strictly_smaller_doc, last), RECORD)
    return rows


def cut(base: DataFrame, ranges: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function over batches of (doc_id, text, ranges) for all documents."""
    return base.join(ranges, "dkey", "left").select("doc_id", "text", "ranges").mapInArrow(function, schema)


def _send(anchors: Callable, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch["doc_id"].is_valid())
            data, offsets = utf8(known["text"])
            dkeys, found = known["dkey"].to_numpy(), []
            for i, j in steps(offsets):
                a = anchors(data, offsets[i : j + 1])
                found.append((a.hash, dkeys[a.doc + i], a.pos.astype(np.int32)))
            if not found:
                continue
            h, d, p = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate([first, [len(h)]]))
            twice = np.repeat(count > 1, count)  # all of these are flagged here and now
            n = np.minimum(count, 2).astype(np.uint8)
            # what is known is sent with bucket numbers that spread it evenly, and count 3
            h, d, p, n = np.concatenate([h[first], h[twice]]), np.concatenate([d[first], d[twice]]), np.concatenate([p[first], p[twice]]), np.concatenate([n, np.full(int(twice.sum()), 3, np.uint8)])
            bucket = ((np.where(n == 3, d, h).view(np.uint64) >> np.uint64(17)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, d, p, n, bucket = h[order], d[order], p[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            ends = [*cuts[1:], len(bucket)]
            pack = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
            if len(cuts):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), *(pa.array(pack(x), pa.binary()) for x in (h, n, d, p))], schema=_SENT)

    return run


def _flag(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of anchors of a bucket that occur at least twice, by document. It holds one record for each anchor and batch at most, of BUCKET_BYTES of text on average."""
    got = [[b"".join(b[c].to_pylist()) for c in ("hashes", "counts", "dkeys", "pos")] for b in batches]
    if not got:
        return
    h, n, d, p = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*got, strict=True), (np.int64, np.uint8, np.int64, np.int32), strict=True))
    del got
    ask = np.flatnonzero(n < 3)
    order = ask[np.argsort(h[ask], kind="stable")]
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order].astype(np.int64), first) if len(s) else first
    yes = np.repeat(total > 1, np.diff(np.concatenate([first, [len(s)]]))) & (n[order] == 1)
    keep = np.concatenate([order[yes], np.flatnonzero(n == 3)])
    keep = keep[np.argsort(d[keep], kind="stable")]
    d, p = d[keep], p[keep]
    for i in range(0, len(d), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(d[i : i + 100_000]), pa.array(p[i : i + 100_000])], schema=_FLAGS)


def _windows(anchors: Callable, records: Callable, strictly: bool) -> Callable:
    """Records of the flagged anchors. Of equal ones in a batch only the earliest is sent to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            ids, dkeys = batch["doc_id"].to_numpy(), batch["dkey"].to_numpy()
            flags, ends = batch["pos"].flatten().to_numpy().astype(np.int64), np.cumsum(np.concatenate([[0], batch["pos"].value_lengths().to_numpy()]))
            rows, seen = [], {}
            for i, j in steps(offsets):
                a = anchors(data, offsets[i : j + 1])
                want = flags[ends[i] : ends[j]] | (np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])) << 32)
                take = np.isin((a.doc << 32) | a.pos, want)
                a = Anchors(*(x[take] for x in (a.doc, a.pos, a.hash, a.lo, a.hi)))
                doc = a.doc + i
                for row in zip(a.hash.tolist(), ids[doc].tolist(), dkeys[doc].tolist(), a.lo.tolist(), *records(data, offsets[i : j + 1], a), strict=True):
                    key = (row[0], row[4], row[6])
                    if (old := seen.get(key)) is None or row[1:4:2] < old:
                        seen[key] = row[1:4:2]
                    rows.append(row)
            out = []
            for h, doc, dkey, start, left, n, body in rows:
                first = seen[h, left, body]
                if doc > first[0] or (not strictly and doc == first[0] and start > first[1]):
                    if out and (last := out[-1])[1] == DECIDED and last[3] == dkey and last[4] + last[6] == start:
                        out[-1] = (*last[:6], last[6] + n, None)
                    else:
                        out.append((dkey, DECIDED, doc, dkey, start, 0, n, None))
                else:
                    out.append((h, GROUPED, doc, dkey, start, left, n, body))
            yield from record_batches(out)

    return run


def record_batches(rows: list[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[i : i + size], strict=True), RECORD_SCHEMA, strict=True)], schema=RECORD_SCHEMA)


def _compared(compare: Callable, strictly: bool, last: bool) -> Callable:
    """Compare records sorted by key: groups as a whole, windows as a stream that holds the digests of one key; unless it is the last time, the first windows go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []
        key, hot, seen, merged = None, False, {}, {}

        def close() -> None:
            if len(group) > 1:
                out.extend((r[3], DECIDED, r[2], r[3], start, 0, n, None) for r, start, n in compare.group(group))

        def rest() -> None:
            for dkey, (doc, ranges) in merged.items():
                out.extend((dkey, DECIDED, doc, dkey, a, 0, b - a, None) for a, b in joined(ranges))
            merged.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] == DECIDED:
                    merged.setdefault(row[3], (row[2], []))[1].append((row[4], row[4] + row[6]))
                    continue
                if row[0] != key:
                    close()
                    group.clear()
                    key, hot, seen = row[0], False, {}
                if row[1] == WINDOW:
                    first = seen.setdefault(row[7][:16], (row[2], row[4]))
                    if row[2] > first[0] or (not strictly and row[2] == first[0] and row[4] > first[1]):
                        for _, start, n in compare.places(row, 0, 1):
                            merged.setdefault(row[3], (row[2], []))[1].append((start, start + n))
                    elif not last:
                        out.append(row)
                elif hot:
                    out.extend(compare.single(row))
                else:
                    group.append(row)
                    if hot := len(group) > HOT:
                        for r in group:
                            out.extend(compare.single(r))
                        group.clear()
                if len(out) >= 10_000:
                    yield from record_batches(out)
                    out.clear()
            rest()
        close()
        rest()
        yield from record_batches(out)

    return run


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges [a, b), with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
