"""Benchmark decontamination by an FM-index per training shard.

A shard is what a task holds at a time. Words that no benchmark item has cannot be in a match, so only runs of
benchmark words as long as the shortest window enter the shard's index; that loses nothing. The index is the
Burrows-Wheeler transform of the runs in a wavelet tree (kept level by level), C counts and sampled suffix positions.
All windows are searched backward at once, occurrences are located by walking to the next sampled position, and their
ranges are merged into removal spans.

The benchmark is a stated query set: it is broadcast in blocks of at most BLOCK_WORDS words (or one item), one block at
a time. With several blocks the texts are written with a number for each row, and the blocks' findings are merged by it,
so that every row has its result whatever the benchmark's size. Null or empty texts and items have no words; an item of
fewer than WINDOW words is one window; items without an id hit words but are not listed; rows repeated in either table
get the same result, each its own; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import rested, spread, staged, steps, utf8

WINDOW = 10
#: Words of benchmark items that are searched at a time; words of runs and documents in a shard; distance of sampled suffixes.
BLOCK_WORDS, SHARD_WORDS, SHARD_DOCS, SAMPLE = 2_000_000, 1_000_000, 20_000, 8
#: Documents in a shard whose rows wait for its verdict.
CLEAN_DOCS = 4_000
#: Bytes of words (digits, letters with A-Z as a-z, and all that isn't ASCII) as they are, all others as spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


class WaveletTree:
    """Ranks of symbols in a sequence; a bit vector for each bit of the symbols, from the highest, each level sorted by the bits above (zeros first)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bits = (symbols >> bit) & 1 == 1
            words = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bit, words, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place at."""
        start = np.zeros_like(at)
        for bit, words, before, zeros in self.levels:
            up = (symbol >> bit) & 1 == 1
            a, b = self._ones(words, before, start), self._ones(words, before, at)
            start, at = np.where(up, zeros + a, start - a), np.where(up, zeros + b, at - b)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for bit, words, before, zeros in self.levels:
            up = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol |= up.astype(np.int64) << bit
            a, b = self._ones(words, before, start), self._ones(words, before, at)
            start, at = np.where(up, zeros + a, start - a), np.where(up, zeros + b, at - b)
        return symbol, at - start


class FmIndex:
    """Over runs of symbols from 1 upward, each followed by a separator 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        order = np.argsort(text, kind="stable")  # separators differ by their place, so no repeat crosses one
        rank = np.empty(n, np.int64)
        new = np.concatenate([[0], (text[order][1:] != text[order][:-1]) | (text[order][1:] == 0)])
        rank[order] = np.cumsum(new)
        step = 1
        while rank.max() < n - 1:
            nxt = np.zeros(n, np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            step *= 2
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletTree(text[order - 1], sigma)
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)  # run starts too: a walk ends before a separator
        self.sample = np.where(kept, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows of equal length): numbers of those that occur, first and last + 1 row."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.counts[-1])
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[which, column]
            low, high = self.counts[symbol] + self.tree.rank(symbol, low), self.counts[symbol] + self.tree.rank(symbol, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix array."""
        out, walk, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            found = self.sample[rows]
            done = found >= 0
            out[todo[done]] = found[done] + walk
            todo, rows = todo[~done], rows[~done]
            symbol, rank = self.tree.access(rows)
            rows, walk = self.counts[symbol] + rank, walk + 1
        return out


def item_windows(items: list[tuple[str | None, list[bytes]]]) -> tuple[dict[bytes, int], dict[int, tuple[np.ndarray, list[list[str]]]]]:
    """Numbers of the items' words, and by length the distinct windows with the ids of their items."""
    vocabulary: dict[bytes, int] = {}
    windows: dict[int, dict[tuple, set]] = {}
    for item, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        size = min(WINDOW, len(ids))
        for i in range(len(ids) - size + 1 if ids else 0):
            windows.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).update([item] if item is not None else [])
    return vocabulary, {n: (np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for n, w in windows.items()}


def _shard(ids: list, n_words: list, text: list, places: list, docs: list, sigma: int, windows: dict) -> pa.RecordBatch:
    """Search a shard: text of runs with separators, the place of each word in its document, the document's number in ids."""
    n = len(ids)
    items: list[set] = [set() for _ in range(n)]
    spans: list[list] = [[] for _ in range(n)]
    hits = np.zeros(n, np.int64)
    text, places, docs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (text, places, docs))
    if len(text):
        index, cover = FmIndex(text, sigma), np.zeros(len(text) + 1, np.int64)
        for size, (patterns, owners) in windows.items():
            which, low, high = index.search(patterns)
            at = index.locate(spread(low, high - low))
            which = np.repeat(which, high - low)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            for pair in np.unique(docs[at] * len(patterns) + which).tolist():
                items[pair // len(patterns)].update(owners[pair % len(patterns)])
        hit = np.cumsum(cover[:-1]) > 0
        hits = np.bincount(docs[hit], minlength=n)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            spans[docs[a]].append({"start": int(places[a]), "end": int(places[b - 1]) + 1})
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(hits), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, _OUT.field("spans").type)], schema=_OUT)


def _scan(block, most_docs: int = SHARD_DOCS) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, windows = item_windows(block.value)
        get, least = vocabulary.get, min(windows, default=1)
        state: tuple[list, ...] = ([], [], [], [], [])
        held = 0
        for batch in batches:
            data, offsets = utf8(batch["text"])
            names = batch["doc_id"].to_pylist()
            for i, j in steps(offsets):
                base = int(offsets[i])
                folded = data[base : int(offsets[j])].tobytes().translate(_FOLD)
                parts = [folded[a:b].split() for a, b in zip((offsets[i:j] - base).tolist(), (offsets[i + 1 : j + 1] - base).tolist(), strict=True)]
                count = np.array([len(p) for p in parts])
                known = np.fromiter((x for p in parts for x in map(get, p, repeat(0))), np.int64, int(count.sum()))
                first = np.cumsum(count) - count
                # runs of known words, ended by unknown words and by documents
                ends = np.zeros(len(known) + 1, np.int8)
                ends[np.concatenate([first, [len(known)]])] = 1
                yes = known > 0
                starts = np.flatnonzero(yes & ~(np.concatenate([[False], yes[:-1]]) & (ends[:-1] == 0)))
                stops = np.flatnonzero(yes & ~(np.concatenate([yes[1:], [False]]) & (ends[1:] == 0))) + 1
                long = stops - starts >= least
                starts, stops = starts[long], stops[long]
                if len(starts):
                    size = stops - starts + 1  # with a separator
                    at = spread(starts, size)
                    text = known[np.minimum(at, len(known) - 1)]
                    text[np.cumsum(size) - 1] = 0
                    doc = np.repeat(np.searchsorted(first, starts, side="right") - 1, size)
                    state[2].append(text)
                    state[3].append(at - first[doc])
                    state[4].append(doc + len(state[0]))
                    held += len(text)
                state[0].extend(names[i:j])
                state[1].extend(count.tolist())
                if held > SHARD_WORDS or len(state[0]) > most_docs:
                    yield _shard(*state, len(vocabulary) + 1, windows)
                    state, held = ([], [], [], [], []), 0
        if state[0]:
            yield _shard(*state, len(vocabulary) + 1, windows)

    return run


def _clean(block) -> Callable:
    """Rows whose text holds no window of the block, as they came; a row is judged where it is read, whatever its id."""
    search = _scan(block, CLEAN_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def numbered() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch["text"]], names=["doc_id", "text"])

        for found in search(numbered()):  # in the order of the rows
            good = pa.array(found["n_hit"].to_numpy() == 0)
            while len(good):
                first = waiting.popleft()
                n = min(len(good), first.num_rows)
                if n < first.num_rows:
                    waiting.appendleft(first.slice(n))
                yield first.slice(0, n).filter(good.slice(0, n))
                good = good.slice(n)

    return run


def without_benchmark(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents (text, ...) whose text holds no window of a benchmark item.

    Nothing is joined: a row is searched and kept or dropped in one pass for each block of the benchmark, so rows
    without a doc_id, with a doc_id that others have too, or repeated are each judged by their own text.
    """
    kinds = ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in documents.dtypes)
    for block in _blocks(benchmark):
        documents = documents.mapInArrow(rested(_clean(documents.sparkSession.sparkContext.broadcast(block))), kinds)
    return documents


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id").toLocalIterator():
        words = (row[1] or "").encode().translate(_FOLD).split()
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    yield block


def find_benchmark(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document its number of words, of words in benchmark windows, the items found (ids as sorted strings) and the removal spans (in words)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    search = lambda rows, block: rows.mapInArrow(rested(_scan(documents.sparkSession.sparkContext.broadcast(block))), SCHEMA)
    blocks = _blocks(benchmark)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return search(texts, block)
    numbered = staged(texts.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("name"), "text"), "numbered")
    parts = [staged(search(numbered, b).where((F.size("spans") > 0) | F.lit(k == 0)), "found") for k, b in enumerate(chain([block, after], blocks))]
    union = reduce(DataFrame.unionByName, parts)
    spans = F.sort_array(F.flatten(F.collect_list("spans")))
    merged = F.aggregate(
        spans,
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda out, s: F.when((F.size(out) > 0) & (s["start"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))),
    )
    one = union.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), merged.alias("spans"))
    named = one.join(numbered.select("doc_id", "name"), "doc_id")
    return named.select(F.col("name").alias("doc_id"), "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"), "items", "spans")
