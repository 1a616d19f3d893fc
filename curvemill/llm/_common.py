"""Helpers shared by the training-data operators: Arrow text buffers, word and window hashes, shared tables."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: ASCII white space, as the word patterns of the operators define it.
SPACES = b" \t\n\r\x0b\x0c"
#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local master, where all is one machine, gets a temporary one if it is unset (tests)."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found := "file://" + tempfile.mkdtemp(prefix="curvemill-"))
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The caller may let go of a table that nothing reads any more by dropped(); what a lazy result reads has to stay, so
    the session's folder is emptied when the application ends, by whoever runs it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a staged table."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of names that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and int64 offsets; null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), off


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents of about limit bytes together, each at least one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def rested(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose worker gives the memory that it no longer uses back to the system when a task ends; a worker lives on into later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        rest()

    return whole


def rest() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes, in place."""
    h ^= h >> U64(32)
    h *= _ODD[3]
    h ^= h >> U64(29)
    h *= _ODD[4]
    h ^= h >> U64(32)
    return h


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its count says."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def bytes_in(some: bytes) -> np.ndarray:
    """For each byte whether it is one of these."""
    out = np.zeros(256, bool)
    out[list(some)] = True
    return out


_IS_SPACE = bytes_in(SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Words longer than this are hashed whole; a shorter one is the sum of a random number for each of its bytes at its place.
_LONG = 32
_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, (2, _LONG * 256), np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool, streams: int = 1, spaces: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words (runs of bytes that aren't spaces, white space if not said) of documents: hashes, starts, ends in data[offsets[0]:offsets[-1]], and the number of each document's first word.

    streams says how many independent 64-bit hashes a word gets; with two, hashes has two rows.
    """
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    off = offsets - base
    shape = lambda h: h[0] if streams == 1 else h
    word = ~spaces[part]
    first = word.copy()
    inner = np.ones(len(part) + 1, bool)
    inner[off] = False  # a document's first byte continues no word
    first[1:] &= ~(word[:-1] & inner[1:-1])
    last = word.copy()
    last[:-1] &= ~(word[1:] & inner[1:-1])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return shape(np.zeros((streams, 0), U64)), starts, ends, np.zeros(len(off), np.int64)
    if lower:
        part = LOWER[part]
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    cell = (np.minimum(place, _LONG - 1) << 8) | part[word]
    hashes = np.stack([np.add.reduceat(table[cell], at) for table in _RANDOM[:streams]])
    hashes += lens.astype(U64) * _ODD[1]
    for k in np.flatnonzero(lens > _LONG).tolist():
        digest = hashlib.blake2b(part[starts[k] : ends[k]].tobytes(), digest_size=16).digest()
        hashes[:, k] = np.frombuffer(digest, U64)[:streams]
    return shape(mix(hashes)), starts, ends, np.searchsorted(starts, off)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes, by doubling; run i starts at i and there are len(h) - n + 1."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, U64)
    out, at, width, power = None, 0, 1, h
    while True:
        if n & width:
            part = power[at : at + total]
            out = part.copy() if out is None else mix(out * _ODD[1] + part)
            at += width
        width *= 2
        if width > n:
            return out
        half = width // 2
        power = mix(power[:-half] * _ODD[0] + power[half:])


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
