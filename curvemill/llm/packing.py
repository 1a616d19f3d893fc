"""Hierarchical packing of token sequences into several context sizes.

Whole blocks of the longest size come straight from long documents. What remains of a document goes to the smallest
tier that holds it. The longest tier is packed first: each remainder opens a window, and its gap is filled with the
largest documents of the shorter tiers that fit; when none fits, one is cut, so that a window ends up exactly full.
The shorter tiers' leftovers are then packed among themselves in windows of their own size. What a batch cannot fill
waits for the next one; the end of a task is cut into windows of powers of two, so no sequence needs padding.

Sequences are grouped into steps of equal tokens over all tasks: they stand in one line by size, the longest first,
then by task, and each STEP_TOKENS of the line are a step. All sizes are powers of two that divide it, so every step but
the last has exactly that many tokens, and only where one size ends and the next begins does a step hold two of them. A
sequence's place comes from its number within its task and size and the prefix sums of the tasks' counts, for which the
packed pieces are written to the shared folder once. Numbers of sequences are a task's own, made unique by its partition.

Tokens come from a tokenizer file; white space ends tokens there, so the ids of a text are those of its pieces between
white space, and pieces that come again are looked up. Null or empty texts have the end token only. Rows repeated are
packed as often; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from typing import ClassVar
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvemill.llm._common import rest, spread, staged, steps, utf8

#: Context sizes, the longest first; tokens of a step; token that ends a document.
TIERS, STEP_TOKENS, END = (2048, 1024, 512, 256), 131072, 1
#: Pieces of text whose ids a worker remembers at once, and tokens that it packs together.
REMEMBERED, HELD_TOKENS = 150_000, 4_000_000
#: Bytes of text that are cut into pieces at a time, and new pieces that the tokenizer gets at a time.
STEP_BYTES, LEARNED = 2 << 20, 4_000
#: A worker that keeps nothing for its next task is short of memory: so many times fewer bytes and pieces at once, for more time.
SPARING = 5
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, size int, ordinal long"
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("size", pa.int32()), ("ordinal", pa.int64())])


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Remembers pieces in two generations of about as many as said (REMEMBERED) each; a worker keeps them from task to task. ASCII is
    lowered first, as the tokenizer does it anyway (but where a text may hold a special token, which is told by case),
    and a mark of punctuation after letters or an ASCII digit ends a piece of its own. New pieces of letters only are
    one word to the tokenizer, whose last token says so; they are encoded side by side in one text and cut there.
    """

    made: ClassVar[dict[str, Tokens]] = {}

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.known, self.old = Tokenizer.from_file(path), remembered, {}, {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.normalizer = self.tokenizer.normalizer
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True

    @classmethod
    def shared(cls, path: str, remembered: int = REMEMBERED) -> Tokens:
        if path not in cls.made:
            cls.made[path] = cls(path, remembered)
        return cls.made[path]

    def of(self, texts: list[bytes]) -> list[bytes]:
        column = pa.array(texts, pa.binary()).cast(pa.string())
        lowered = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        pieces = pc.ascii_split_whitespace(lowered)
        coded = pieces.flatten().dictionary_encode()  # each distinct piece of these texts is looked up once
        listed = pa.LargeListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        distinct = pc.binary_join(listed, " ")[0].as_py().encode().split(b" ")  # pieces have no blanks
        ids = list(map(self.known.get, distinct))
        if gaps := [i for i, x in enumerate(ids) if x is None]:
            self._learn({distinct[i] for i in gaps})
            for i in gaps:
                ids[i] = self.known[distinct[i]]
        ids.append(np.array([END], "<u4").tobytes())
        # the pieces of all texts as numbers of distinct ones, with the end token after each text
        stops = np.cumsum(pieces.value_lengths().to_numpy())
        order = np.insert(coded.indices.to_numpy(), stops, len(distinct))
        size = np.array([len(x) // 4 for x in ids])
        tokens = np.frombuffer(b"".join(ids), "<u4")[spread((np.cumsum(size) - size)[order], size[order])].tobytes()
        ends = (4 * np.cumsum(size[order])[stops + np.arange(len(stops))]).tolist()
        return [tokens[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def rest(self, keep: bool) -> None:
        """Between tasks only the newer pieces are kept, or nothing at all, and unused memory is given back."""
        self.old = {}
        if not keep:
            self.known = {}
            self.made.clear()

    def _learn(self, wanted: set[bytes]) -> None:
        if len(self.known) > self.remembered:
            self.known, self.old = {}, self.known
        ended, words, others = [], set(), set()
        for piece in wanted:
            if found := self.old.get(piece):
                self.known[piece] = found
            elif is_word(piece):
                words.add(piece)
            elif piece[-1:] in b".,!?;:" and (is_word(piece[:-1]) or piece[-2:-1].isalnum()):
                ended.append(piece)
                (words if is_word(piece[:-1]) else others).add(piece[:-1])
                others.add(piece[-1:])
            else:
                others.add(piece)
        new = [x for x in words if x not in self.known]
        for i in range(0, len(new), LEARNED):
            self._learn_words(new[i : i + LEARNED])
        self._learn_each([x for x in others if x not in self.known])
        for piece in ended:
            self.known[piece] = self.known[piece[:-1]] + self.known[piece[-1:]]

    def _learn_words(self, words: list[bytes]) -> None:
        self.tokenizer.normalizer = None  # they are normalised and lowered already
        try:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        finally:
            self.tokenizer.normalizer = self.normalizer
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) != len(words):  # the tokenizer's notion of a letter isn't ours
            return self._learn_each(words)
        data, stops = ids.tobytes(), stops.tolist()
        self.known.update(zip(words, [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))

    def _learn_each(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), LEARNED):
            some = pieces[i : i + LEARNED]
            for piece, found in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                self.known[piece] = np.array(found.ids, "<u4").tobytes()


def is_word(piece: bytes) -> bool:
    """Whether a piece is letters only, normalised and in lower case."""
    if piece.isascii():
        return piece.isalpha() and piece.islower()
    text = piece.decode()
    return text.isalpha() and text.lower() == text and is_normalized("NFC", text)


Piece = tuple[int, int, int]  # number of the document, first token, tokens


class Packer:
    """Fills windows from pieces; what is left of a batch stays in the tiers, as (length, document, start), sorted."""

    def __init__(self):
        self.tiers: list[list[tuple[int, int, int]]] = [[] for _ in TIERS]

    def add(self, doc: int, start: int, length: int) -> None:
        if length:
            tier = next(k for k in reversed(range(len(TIERS))) if TIERS[k] >= length)
            insort(self.tiers[tier], (length, doc, start))

    def _take(self, gap: int, top: int) -> tuple[int, int, int] | None:
        """The largest piece of at most gap tokens in tiers from top down, or else gap tokens of the smallest that there is."""
        for tier in self.tiers[top:]:
            if at := bisect_right(tier, (gap, 1 << 60, 0)):
                return tier.pop(at - 1)
        for tier in reversed(self.tiers):
            if tier:
                length, doc, start = tier.pop(0)
                self.add(doc, start + gap, length - gap)
                return gap, doc, start
        return None

    def windows(self) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows, the longest tier first; a window that can't be filled is put back."""
        for k, size in enumerate(TIERS):
            while self.tiers[k]:
                length, doc, start = self.tiers[k].pop()
                window, gap = [(doc, start, length)], size - length
                while gap and (found := self._take(gap, k)):
                    window.append((found[1], found[2], found[0]))
                    gap -= found[0]
                if gap:  # nothing is left
                    for piece in window:
                        self.add(*piece)
                    return
                yield size, window

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """What is left, in windows of powers of two."""
        left = [(doc, start, length) for tier in self.tiers for length, doc, start in tier]
        total = sum(p[2] for p in left)
        self.tiers = [[] for _ in TIERS]
        while total:
            size = min(TIERS[0], 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc, start, length = left.pop()
                if length > gap:
                    left.append((doc, start + gap, length - gap))
                window.append((doc, start, min(length, gap)))
                gap -= min(length, gap)
            total -= size
            yield size, window


def _packed(path: str, keep: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less = 1 if keep else SPARING
        tokens, packer = Tokens.shared(path, REMEMBERED // less), Packer()
        first = TaskContext.get().partitionId() << 32
        names: list = []
        ids: dict[int, bytes] = {}
        left: dict[int, int] = {}  # tokens of each document that aren't in a window yet
        numbers, of_size, held, rows = 0, {}, 0, []

        def close(size: int, window: list[Piece]) -> None:
            nonlocal numbers
            tier, ordinal = max(TIERS[-1], size), of_size.get(size, 0)
            of_size[size] = ordinal + 1
            offset = 0
            for doc, start, length in window:
                data = ids[doc]
                rows.append((names[doc], start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), len(data) // 4, first + numbers, offset, tier, size, ordinal))
                offset += length
                left[doc] -= length
                if not left[doc]:
                    del left[doc], ids[doc]
            numbers += 1

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 20_000], strict=True), _OUT, strict=True)], schema=_OUT)
            rows.clear()

        for batch in batches:
            data, offsets = utf8(batch["text"])
            docs = batch["doc_id"].to_pylist()
            for i, j in steps(offsets, STEP_BYTES // less):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                for name, found in zip(docs[i:j], tokens.of(texts), strict=True):
                    doc, n = len(names), len(found) // 4
                    names.append(name)
                    ids[doc], left[doc] = found, n
                    held += n
                    for start in range(0, n - TIERS[0] + 1, TIERS[0]):
                        close(TIERS[0], [(doc, start, TIERS[0])])
                    if n % TIERS[0]:
                        packer.add(doc, n - n % TIERS[0], n % TIERS[0])
                if held > HELD_TOKENS:
                    for size, window in packer.windows():
                        close(size, window)
                    held = 0
                    yield from out()
        for size, window in packer.windows():
            close(size, window)
        for size, window in packer.rest():
            close(size, window)
        yield from out()
        tokens.rest(keep)
        del tokens
        rest()

    return run


def stepped(pieces: DataFrame) -> DataFrame:
    """Pieces with step_id in place of size and ordinal; pieces are read twice.

    What is put in order is a row for each task and size (at most twelve sizes), with a window for each size.
    """
    task = F.shiftright("sequence_id", 32).alias("task")
    counts = pieces.groupBy(task, "size").agg(((F.max("ordinal") + 1) * F.col("size")).alias("tokens"))
    sizes = counts.groupBy(F.col("size").alias("of_size")).agg(F.sum("tokens").alias("all"))
    longer = sizes.withColumn("longer", F.coalesce(F.sum("all").over(W.orderBy(F.desc("of_size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("all")
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("size").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.withColumn("before", before).join(longer, F.col("size") == F.col("of_size")).select("task", "size", (F.col("longer") + F.col("before")).alias("begin"))
    placed = pieces.withColumn("task", task).join(begins, ["task", "size"])
    step = F.floor((F.col("begin") + F.col("ordinal") * F.col("size")) / STEP_TOKENS).cast("long")
    return placed.withColumn("step_id", step).select(*(c for c in pieces.columns if c not in ("size", "ordinal")), "step_id")


def stepped_by_task(pieces: DataFrame) -> DataFrame:
    """Pieces with a step_id that groups a task's sequences of one size, without another pass: a task's last step of each size is short."""
    index = F.floor(F.col("ordinal") * F.col("size") / STEP_TOKENS)
    step = F.shiftleft(F.shiftright("sequence_id", 32), 32) + F.log2("size").cast("long") * (1 << 24) + index
    return pieces.withColumn("step_id", step.cast("long")).drop("size", "ordinal")


def pack(documents: DataFrame, tokenizer: str, keep: bool = True, balanced: bool = True) -> DataFrame:
    """A row for each piece of a document: its place in the document, in its sequence, and the sequence's tier and step.

    balanced: steps over all tasks; packs now, and the result reads what was written. Otherwise steps are a task's own.

    keep: whether a worker keeps the tokenizer and what it remembers (some 100 MB) for its next task.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = texts.mapInArrow(_packed(tokenizer, keep), SCHEMA)
    return stepped(staged(pieces, "packed")) if balanced else stepped_by_task(pieces)
