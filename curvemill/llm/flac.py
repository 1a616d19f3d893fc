"""Text bytes as FLAC: an encoder and a decoder that work on all frames of a step at once.

A text's bytes, padded with spaces to a positive multiple of BLOCK, are 8-bit mono samples (byte - 128), a frame for
each BLOCK of them. Every frame has the cheapest of the fixed predictors of order 0 to 4 and a quantised linear
predictor of order 2, and one Rice partition of the residual; a frame of one value is constant, one that would not get
smaller is verbatim. A seek table lists a frame in SEEK, which makes any sample offset reachable without what comes
before, and application blocks list the sizes of all frames (two bytes each), which lets the decoder take many frames
side by side, a slice of SLICE frames at a time whatever a text's length. It checks the header's CRC-8 and the frame's CRC-16, reads Rice codes
(of any partition order) with a 64-bit window, undoes fixed and linear predictors of any order up to 32, and compares
the samples' MD5 with the stream's. What the query reports is read from PCM blocks, each of which starts at a seek
point, and the end of each stream by a seek.

Null counts as empty; a payload is never empty. Equal texts give equal streams. Rows repeated give equal rows; extra
columns are ignored. A damaged stream raises ValueError. A text takes about five times its bytes in memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import spread, steps, utf8

#: Samples of a frame (block size code 1 of the format), sample rate and its code, bits of a coefficient of the linear predictor and of its shift.
BLOCK, RATE, RATE_CODE, PRECISION, SHIFT = 192, 8000, 4, 12, 9
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Payload bytes of a step, frames that are worked on at once, frames between seek points, frames whose sizes an application block lists.
STEP, SLICE, SEEK, LISTED = 768 * 1024, 4096, 64, 1 << 20
#: Name of the application blocks.
SIZES = b"SIZE"


def _table(poly: int, bits: int) -> np.ndarray:
    top, out = 1 << (bits - 1), []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & ((1 << bits) - 1)
        out.append(crc)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each range, all of them a byte at a time."""
    out = np.zeros(len(starts), np.int64)
    order = np.argsort(-lengths, kind="stable")
    at, crc, sizes = starts[order], out.copy(), lengths[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, side="left"))  # those longer than k
        byte = data[at[:n] + k]
        crc[:n] = table[byte] if bits == 8 and k == 0 else table[(crc[:n] >> (bits - 8)) ^ byte] ^ ((crc[:n] << 8) & ((1 << bits) - 1))
    out[order] = crc
    return out


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as the format codes them: up to six bytes (left-aligned columns) and how many."""
    cols, size = np.zeros((len(n), 6), np.int64), np.ones(len(n), np.int64)
    for k, bits in enumerate((7, 11, 16, 21, 26)):
        size[n >= 1 << bits] = k + 2
    for k in range(1, 7):
        some = size == k
        cols[some, 0] = ((0xFF00 >> k) & 0xFF if k > 1 else 0) | (n[some] >> (6 * (k - 1)))
        for j in range(1, k):
            cols[some, j] = 0x80 | ((n[some] >> (6 * (k - 1 - j))) & 0x3F)
    return cols, size


def _residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For frames x (rows of samples): kind (0 to 4 fixed, 5 linear), residuals with the order's first samples zero, and the linear predictor's coefficients."""
    best, kind, least = x.copy(), np.zeros(len(x), np.int64), np.abs(x).sum(axis=1)
    diff = x
    for order in range(1, 5):
        diff = np.concatenate([np.zeros((len(x), 1), x.dtype), diff[:, 1:] - diff[:, :-1]], axis=1)
        diff[:, :order] = 0
        cost = np.abs(diff).sum(axis=1)
        better = cost < least
        best[better], kind[better], least[better] = diff[better], order, cost[better]
    # order 2 by the normal equations, then rounded
    f = x.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, lag:], f[:, : BLOCK - lag]).astype(np.float64) for lag in range(3))
    det = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    limit = (1 << (PRECISION - 1)) - 1
    coef = np.stack([np.clip(np.rint(v / det * (1 << SHIFT)), -limit, limit) for v in (r1 * (r0 - r2), r0 * r2 - r1 * r1)], axis=1).astype(np.int32)
    linear = np.zeros_like(x)
    linear[:, 2:] = x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> SHIFT)
    cost = np.abs(linear).sum(axis=1) + 2 * PRECISION
    better = cost < least
    best[better], kind[better] = linear[better], 5
    return kind, best, coef


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of samples (rows) with their numbers to bytes one after another, and each frame's size."""
    n = len(x)
    kind, residual, coef = _residuals(x)
    order = np.where(kind == 5, 2, kind)
    column = np.arange(BLOCK)
    u = (residual << 1) ^ (residual >> 31)
    guess = np.maximum(0, np.log2(np.maximum(u.sum(axis=1) / BLOCK, 1)).astype(np.int64))
    cost = np.stack([(u >> np.minimum(guess + d, 14)[:, None]).sum(axis=1) + BLOCK * np.minimum(guess + d, 14) for d in range(2)])
    k = np.minimum(guess + cost.argmin(axis=0), 14).astype(np.int32)
    quotient = u >> k[:, None]
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & ((quotient.max(axis=1) > 40) | ((quotient + 1).sum(axis=1) + BLOCK * k > 8 * BLOCK))
    coded = ~constant & ~verbatim

    cols, size = _utf8_number(number)
    head = [np.full(n, 0xFF), np.full(n, 0xF8), np.full(n, (1 << 4) | RATE_CODE), np.full(n, 1 << 1), *cols.T, np.zeros(n, np.int64)]
    lens = [np.full(n, 8)] * 4 + [np.where(size > j, 8, 0) for j in range(6)] + [np.full(n, 8)]
    grid = np.stack(head[:10], axis=1).astype(np.uint8)
    head[10] = _crcs(grid.ravel(), np.arange(n) * 10, 4 + size, _CRC8, 8)
    head.append(np.where(constant, 0, np.where(verbatim, 2, np.where(kind == 5, 0x42, 16 + 2 * kind))))  # subframe header: type in bits 1 to 6
    lens.append(np.full(n, 8))
    warm = np.where(constant, 1, np.where(verbatim, BLOCK, order))
    most = BLOCK if verbatim.any() else 4
    first = (x & 0xFF)[:, :most]
    first_len = np.where(column[:most] < warm[:, None], np.int32(8), np.int32(0))
    is_linear = coded & (kind == 5)
    mid = [np.full(n, PRECISION - 1), np.full(n, SHIFT), coef[:, 0] & ((1 << PRECISION) - 1), coef[:, 1] & ((1 << PRECISION) - 1), np.zeros(n, np.int64), k]
    mid_len = [np.where(is_linear, b, 0) for b in (4, 5, PRECISION, PRECISION)] + [np.where(coded, b, 0) for b in (6, 4)]
    rice = coded[:, None] & (column >= order[:, None])
    codes = np.where(rice, (np.int32(1) << k[:, None]) | (u & ((np.int32(1) << k[:, None]) - 1)), np.int32(0))
    code_len = np.where(rice, quotient + 1 + k[:, None], np.int32(0))
    small = lambda x: np.stack(x, axis=1).astype(np.int32)
    values = np.concatenate([small(head), first, small(mid), codes], axis=1)
    widths = np.concatenate([small(lens), first_len, small(mid_len), code_len], axis=1)

    bits = widths.sum(axis=1)
    sizes = (bits + 7) // 8 + 2
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(widths, axis=1, dtype=np.int32) + (8 * starts[:, None]).astype(np.int32)
    some = widths.ravel() > 0
    values, last = values.ravel()[some], ends.ravel()[some] - 1
    out = np.zeros(int(sizes.sum()) + 3, np.int32)
    byte = last >> 3
    shifted = values << (7 - (last & 7))
    new = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    place = byte[new] + 3
    for back in range(3):  # fields don't overlap, so sums are unions
        out[place - back] += np.add.reduceat((shifted >> (8 * back)) & np.int32(0xFF), new)
    out = out[3:]
    check = _crcs(out, starts, sizes - 2, _CRC16, 16)
    out[starts + sizes - 2], out[starts + sizes - 1] = check >> 8, check & 0xFF
    return out.astype(np.uint8), sizes


def _block(kind: int, body: bytes, last: bool = False) -> bytes:
    return bytes([kind | 128 * last]) + len(body).to_bytes(3, "big") + body


def _headers(payload: bytes, sizes: np.ndarray) -> bytes:
    """Stream marker, stream information, a seek table and the sizes of all frames."""
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big")
    info += hashlib.md5((np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()).digest()
    points = np.zeros(len(range(0, len(sizes), SEEK)), [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
    points["sample"], points["offset"], points["samples"] = np.arange(len(points)) * SEEK * BLOCK, (np.cumsum(sizes) - sizes)[::SEEK], BLOCK
    lists = [_block(2, SIZES + sizes[i : i + LISTED].astype(">u2").tobytes(), i + LISTED >= len(sizes)) for i in range(0, len(sizes), LISTED)]
    return b"fLaC" + _block(0, info) + _block(3, points.tobytes()) + b"".join(lists)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (multiples of BLOCK bytes)."""
    count = np.array([len(p) // BLOCK for p in payloads])
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    number = spread(np.zeros(len(count), np.int64), count)
    parts = [encode_frames(samples[i : i + SLICE].astype(np.int32) - np.int32(128), number[i : i + SLICE]) for i in range(0, len(samples), SLICE)]
    data, sizes = b"".join(d.tobytes() for d, _ in parts), np.concatenate([n for _, n in parts])
    frame, at, out = np.cumsum(count) - count, np.concatenate([[0], np.cumsum(sizes)]), []
    for payload, a, n in zip(payloads, frame.tolist(), count.tolist(), strict=True):
        out.append(_headers(payload, sizes[a : a + n]) + data[at[a] : at[a + n]])
    return out


def parse(stream: bytes) -> dict:
    """Metadata of a stream: block size, bits, samples, md5, where frames begin, the sizes of the frames and the seek points (sample, offset, samples)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, sizes, found = 4, [np.zeros(0, np.int64)], {"points": np.zeros((0, 3), np.int64)}
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(body[10:18], "big")
            found |= {"block": int.from_bytes(body[2:4], "big"), "bits": ((packed >> 36) & 31) + 1, "channels": ((packed >> 41) & 7) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind & 127 == 3:
            points = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
            found["points"] = np.stack([points[c].astype(np.int64) for c in ("sample", "offset", "samples")], axis=1)
        elif kind & 127 == 2 and body[:4] == SIZES:
            sizes.append(np.frombuffer(body[4:], ">u2").astype(np.int64))
        at += 4 + size
        if kind & 128:
            return found | {"frames": at, "sizes": np.concatenate(sizes)}


class _Bits:
    """A reading place in each lane of a byte buffer."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.words = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))
        self.at = at.copy()

    def peek(self, lanes: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The next 57 bits or more, from the top."""
        at = self.at[lanes]
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def read(self, width: int, lanes: np.ndarray | slice = slice(None)) -> np.ndarray:
        found = self.peek(lanes) >> np.uint64(64 - width)
        self.at[lanes] += width
        return found.astype(np.int64)

    def signed(self, width: int, lanes: np.ndarray | slice = slice(None)) -> np.ndarray:
        found = self.read(width, lanes)
        return found - ((found >> (width - 1)) << width)

    def zeros(self, lanes: np.ndarray) -> np.ndarray:
        """Length of the run of zeros, which is skipped with the one that ends it."""
        run, todo = np.zeros(len(lanes), np.int64), np.arange(len(lanes))
        while len(todo):
            top = (self.peek(lanes[todo]) >> np.uint64(32)).astype(np.float64)
            lead = 32 - np.frexp(top)[1]
            run[todo] += lead
            self.at[lanes[todo]] += lead + (lead < 32)
            todo = todo[lead == 32]
        return run


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int, bits: int, number: np.ndarray) -> np.ndarray:
    """Samples of mono frames data[start:end], a row each."""
    n = len(starts)
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    if ((data[starts] != 0xFF) | (data[starts + 1] != 0xF8)).any():
        raise ValueError("no frame where the seek table has one")
    size = _utf8_number(number)[1]
    if (_crcs(data, starts, 4 + size, _CRC8, 8) != data[starts + 4 + size]).any():
        raise ValueError("a frame header's CRC-8 is wrong")
    check = (data[ends - 2].astype(np.int64) << 8) | data[ends - 1]
    if (_crcs(data, starts, ends - starts - 2, _CRC16, 16) != check).any():
        raise ValueError("a frame's CRC-16 is wrong")
    bit = _Bits(data, 8 * (starts + 5 + size))
    kind = bit.read(8) >> 1
    out = np.zeros((n, block), np.int64)
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind & 0x38) == 8, (kind & 0x20) == 0x20
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("a subframe of a reserved type")
    if constant.any():
        out[constant] = bit.signed(bits, np.flatnonzero(constant))[:, None]
    plain = np.flatnonzero(verbatim)
    for i in range(block if len(plain) else 0):
        out[plain, i] = bit.signed(bits, plain)
    lanes = np.flatnonzero(fixed | linear)
    if not len(lanes):
        return out
    order = np.where(fixed[lanes], kind[lanes] & 7, (kind[lanes] & 31) + 1)
    most = int(order.max())
    x = np.zeros((most + block, len(lanes)), np.int64)  # a sample's row is shifted by most, so that it always has a past
    for i in range(most):
        some = np.flatnonzero(order > i)
        x[most + i, some] = bit.signed(bits, lanes[some])
    coef, shift = np.zeros((most, len(lanes)), np.int64), np.zeros(len(lanes), np.int64)
    for o in range(1, 5):
        mine = np.flatnonzero(fixed[lanes] & (order == o))
        if len(mine):
            coef[:o, mine] = np.array(_FIXED[o])[:, None]
    own = np.flatnonzero(linear[lanes])
    if len(own):
        precision = bit.read(4, lanes[own]) + 1
        shift[own] = bit.read(5, lanes[own])
        for i in range(most):
            for width in np.unique(precision[order[own] > i]).tolist():
                some = own[(order[own] > i) & (precision == width)]
                coef[i, some] = bit.signed(width, lanes[some])
    method, parts = bit.read(2, lanes), bit.read(4, lanes)
    rice, span = np.zeros(len(lanes), np.int64), block >> parts
    everyone, taken = np.arange(len(lanes)), np.zeros(len(lanes), np.int64)
    escape = np.where(method == 1, 31, 15)
    raw = np.zeros(len(lanes), np.int64)
    for i in range(block):
        fresh = everyone[i % span == 0] if i else everyone
        for width, some in ((4, fresh[method[fresh] == 0]), (5, fresh[method[fresh] == 1])):
            if len(some):
                rice[some] = bit.read(width, lanes[some])
                odd = some[rice[some] == escape[some]]
                raw[some] = -1
                if len(odd):
                    raw[odd] = bit.read(5, lanes[odd])
        live = everyone[order <= i] if i < most else everyone
        code = live[raw[live] < 0] if (raw >= 0).any() else live
        residual = taken if len(live) == len(lanes) else np.zeros(len(lanes), np.int64)
        k = rice[code]
        quotient = bit.zeros(lanes[code])
        low = ((bit.peek(lanes[code]) >> np.uint64(1)) >> (63 - k).astype(np.uint64)).astype(np.int64)
        bit.at[lanes[code]] += k
        u = (quotient << k) | low
        residual[code] = (u >> 1) ^ -(u & 1)
        if len(code) < len(live):
            for width in np.unique(raw[raw >= 0]).tolist():
                some = live[raw[live] == width]
                residual[some] = bit.signed(width, lanes[some]) if width else 0
        guess = coef[0] * x[most + i - 1] if most else np.zeros(len(lanes), np.int64)
        for j in range(1, most):
            guess = guess + coef[j] * x[most + i - 1 - j]
        value = residual + (guess >> shift)
        if len(live) == len(lanes):
            x[most + i] = value
        else:
            x[most + i, live] = value[live]
    out[lanes] = x[most:].T
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, checked against its MD5; a stream that is cut short or of another form is a ValueError."""
    try:
        return _payloads(streams)
    except (IndexError, KeyError, TypeError, OverflowError) as e:
        raise ValueError("a stream is cut short, or has no sizes of its frames") from e


def _info(stream: bytes) -> dict:
    """parse() of a stream that decode() can read, with where its frames end."""
    info = parse(stream)
    if (info["block"], info["bits"], info["channels"]) != (BLOCK, 8, 1):
        raise ValueError("streams with one channel of 8 bits and this block size are read")
    ends, points = info["frames"] + np.cumsum(info["sizes"]), info["points"]
    begin = ends - info["sizes"] - info["frames"]
    if ends[-1] != len(stream) or (begin[points[:, 0] // BLOCK] != points[:, 1]).any():
        raise ValueError("the sizes of the frames don't agree with the stream or its seek table")
    return info | {"ends": ends}


def read_at(streams: list[bytes], starts: list[int], count: int) -> list[bytes]:
    """count samples (signed, a byte each) of every stream from its start on; only the frames that hold them are decoded.

    The last seek point that isn't behind the start gives a frame's number and place; frames between it and the start
    are stepped over by their sizes. A start that leaves fewer than count samples is a ValueError, as a damaged stream is.
    """
    try:
        cut, begins, ends, numbers, kept, at = [], [], [], [], [], 0
        for stream, start in zip(streams, starts, strict=True):
            info = _info(stream)
            if start < 0 or start + count > info["samples"]:
                raise ValueError("samples beyond the stream's")
            point = info["points"][np.searchsorted(info["points"][:, 0], start, side="right") - 1]
            first, last = int(point[0]) // BLOCK, (start + count - 1) // BLOCK
            size = info["sizes"][first : last + 1]
            place = info["frames"] + int(point[1]) + np.cumsum(size) - size  # of the frames from the seek point on
            skip = start // BLOCK - first
            cut.append(stream[place[skip] : place[-1] + size[-1]])
            begins.append(place[skip:] - place[skip] + at)
            ends.append(begins[-1] + size[skip:])
            numbers.append(np.arange(first + skip, last + 1))
            kept.append((last + 1 - first - skip, start % BLOCK))
            at += len(cut[-1])
        found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends, numbers)]
        frames = decode_frames(np.frombuffer(b"".join(cut), np.uint8), found[0], found[1], BLOCK, 8, found[2]).astype(np.int8)
    except (IndexError, KeyError, TypeError, OverflowError) as e:
        raise ValueError("a stream is cut short, or has no sizes of its frames") from e
    out, row = [], 0
    for n, off in kept:
        out.append(frames[row : row + n].tobytes()[off : off + count])
        row += n
    return out


def _payloads(streams: list[bytes]) -> list[bytes]:
    infos = [_info(s) for s in streams]
    base = np.cumsum([0] + [len(s) for s in streams])
    ends = [info["ends"] + at for info, at in zip(infos, base[:-1].tolist(), strict=True)]
    sizes, ends = np.concatenate([i["sizes"] for i in infos]), np.concatenate(ends)
    number = spread(np.zeros(len(infos), np.int64), np.array([len(i["sizes"]) for i in infos]))
    data, pcm = np.frombuffer(b"".join(streams), np.uint8), np.zeros((len(sizes), BLOCK), np.int8)
    for i in range(0, len(sizes), SLICE):
        some = slice(i, i + SLICE)
        first = ends[i] - sizes[i]
        pcm[some] = decode_frames(data[first : ends[some][-1]], ends[some] - sizes[some] - first, ends[some] - first, BLOCK, 8, number[some])
    out, row = [], 0
    for info in infos:
        mine = pcm[row : row + len(info["sizes"])]
        row += len(mine)
        if hashlib.md5(mine.tobytes()).digest() != info["md5"] or mine.size != info["samples"]:
            raise ValueError("the samples' MD5 is wrong")
        out.append((mine.view(np.uint8) + np.uint8(128)).tobytes())
    return out


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text and its FLAC stream (media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for i, j in steps(offsets, STEP):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.array(encode(list(map(payload_of, texts))), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: Samples at a stream's end that are read by a seek.
TAIL = 16
_PCM = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sample_offset", pa.int64()), ("pcm", pa.binary()), ("n_samples", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tail", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pcm_blocks(stored: DataFrame, samples: int = SEEK * BLOCK) -> DataFrame:
    """Blocks of decoded signed 8-bit PCM with the sample at which each starts, which by default is where a seek point is.

    A document's blocks come one after another in a task, in order. Each tells the document's text bytes and samples,
    its stream's size and digest, and the last TAIL samples as they are found by a seek, without what is before them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch["media"])
            for i, j in steps(offsets, STEP):
                part, rows = batch.slice(i, j - i), []
                media = part["media"].to_pylist()
                payloads = decode(media)
                tails = read_at(media, [len(p) - TAIL for p in payloads], TAIL)
                for doc, n, m, p, tail in zip(part["doc_id"].to_pylist(), part["n_bytes"].to_pylist(), media, payloads, tails, strict=True):
                    pcm, digest = (np.frombuffer(p, np.uint8) - np.uint8(128)).tobytes(), hashlib.sha256(m).hexdigest()
                    rows += [(doc, n, at, pcm[at : at + samples], len(p), len(m), digest, tail) for at in range(0, len(p), samples)]
                for a in range(0, len(rows), 2000):
                    yield _batch(rows[a : a + 2000], _PCM)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, sample_offset long, pcm binary, n_samples long, media_bytes long, media_sha256 string, tail binary")


class _Samples:
    """What is known of a document's samples after some of its blocks."""

    def __init__(self):
        self.n = self.sum = self.squares = self.turns = 0
        self.below: bool | None = None
        self.payload, self.last = hashlib.sha256(), b""

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.int8).astype(np.int32)
        below = x < 0
        self.turns += int((below[1:] != below[:-1]).sum()) + (self.below is not None and self.below != bool(below[0]))
        self.n, self.below = self.n + len(x), bool(below[-1])
        self.sum, self.squares = self.sum + int(x.sum()), self.squares + int((x * x).sum())
        self.payload.update(_unsigned(pcm))
        self.last = (self.last + pcm[-TAIL:])[-TAIL:]

    def feature(self) -> str:
        return f"mean={self.sum / self.n:.4f};rms={np.sqrt(self.squares / self.n):.4f};turns={self.turns}"


def _unsigned(pcm: bytes) -> bytes:
    return (np.frombuffer(pcm, np.uint8) + np.uint8(128)).tobytes()


def digests(stored: DataFrame) -> DataFrame:
    """What the stored streams hold when read back, and a feature of their samples: mean, root mean square, sign changes.

    Everything is taken from the PCM blocks, which are read as they come, so that a text's length doesn't matter here;
    the end's checksum is that of the samples which a seek finds. A block that is missing, or an end that isn't the
    blocks', is a ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Samples()
        for batch in batches:
            rows = []
            for doc, n, at, pcm, samples, size, digest, tail in zip(*(batch[c].to_pylist() for c in _PCM.names), strict=True):
                if at != now.n:
                    raise ValueError("blocks of samples out of order")
                now.add(pcm)
                if now.n == samples:
                    if tail != now.last:
                        raise ValueError("a seek to the end finds other samples")
                    rows.append((doc, n, samples, now.payload.hexdigest(), zlib.crc32(_unsigned(tail)), size, digest, now.feature()))
                    now = _Samples()
            if rows:
                yield _batch(rows, _DIGEST)
        if now.n:
            raise ValueError("the last blocks of samples are missing")

    return pcm_blocks(stored).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
