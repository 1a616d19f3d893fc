"""Collocations by SETM: relations of phrase occurrences, extended word by word.

A text is lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, these into words at blanks and tabs; all
counts are per lang. The relation of length k says where which frequent phrase of k words begins. It is a table, in
chunks of text: a row holds a chunk's phrases sorted by place, with a gap wherever the next phrase doesn't begin one
word later in the same piece.

For each length from 2 to LONGEST

* every relation is merge-joined with itself by piece and adjacent place: two phrases of k - 1 words that begin at
  neighbouring places make one of k words, and no other phrase can be frequent;
* the joined occurrences are counted by phrase, within the chunk first, then over all chunks;
* phrases of at least LEAST occurrences stay: each chunk learns which of its own these are (by the phrase's total on
  each of its rows, then a semi-join by chunk), and the kept occurrences are written as the next relation.

The first relation holds every word: words that are too rare vanish with the first count, and leaving them out before
would take a join of its own, which saves the less the larger the corpus is.

A word is told by its number in a written table, a longer phrase by those of the two phrases that it joins, and then by
its place in the first chunk that has it, so nothing rests on hashes beyond a chunk's own words. A group of the count has no more rows than there are chunks, however frequent the phrase.

Scores, cuts and the first TOP of each lang come from the tables of frequent phrases alone, in decimals.

Null texts are empty; a null lang is ``und``; doc_id and other columns are not read; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvemill.llm._common import LOWER, bytes_in, dropped, rested, spread, staged, steps, utf8, words_of

#: Least occurrences of a phrase, its most words, how many of each lang are reported.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text whose occurrences are one row, rows of a batch to Spark, parts in which a lang is ranked first.
CHUNK_BYTES, OUT_ROWS, RANK_PARTS = 6 << 20, 1 << 17, 64
#: A chunk's number is its task's (20 bits) and its own there (14 bits); with a code below 2 ** CODE_BITS it makes a phrase's id.
CHUNK_BITS, CODE_BITS = 14, 29
#: What ends a piece, and what also ends a word.
_ENDS_PIECE, _ENDS_WORD = bytes_in(b".,;:!?\n\x0b\x0c\r"), bytes_in(b".,;:!?\n\x0b\x0c\r \t")
#: codes: numbers of phrases among the chunk's own, or a gap, as _packed makes them; items: the 64-bit ids of the chunk's phrases, ascending.
RELATION = "chunk long, codes binary, items binary"


def _packed(codes: np.ndarray) -> bytes:
    """Numbers from -1 (a gap) up as 32 bits, first the low bytes of all, then the next ones: the high ones are alike and compress."""
    return (codes + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(value: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(value.as_buffer(), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel() - np.int32(1)


def _closed(codes: np.ndarray) -> np.ndarray:
    """Codes with one gap where there are several."""
    keep = codes >= 0
    keep[1:] |= codes[:-1] >= 0
    return codes[keep]


def _words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of a chunk's words with gaps between pieces, the distinct words, and how often each occurs."""
    data, offsets = utf8(text)
    hashes, starts, ends, breaks = [], [], [], []
    for i, j in steps(offsets):
        h, a, b, first = words_of(data, offsets[i : j + 1], lower=True, spaces=_ENDS_WORD)
        piece = np.cumsum(_ENDS_PIECE[data[offsets[i] : offsets[j]]])[a]
        new = np.ones(len(h), bool)
        new[1:] = piece[1:] != piece[:-1]
        new[first[first < len(h)]] = True
        for kept, value in ((hashes, h), (starts, a + offsets[i]), (ends, b + offsets[i]), (breaks, new)):
            kept.append(value)
    if not hashes or not sum(map(len, hashes)):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    _, at, found, counts = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True, return_counts=True)
    breaks = np.concatenate(breaks)
    codes = np.full(len(found) + int(breaks.sum()), -1)
    codes[np.arange(len(found)) + np.cumsum(breaks)] = found
    begin = np.concatenate(starts)[at]
    length = np.concatenate(ends)[at] - begin
    into = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(into), pa.py_buffer(LOWER[data[spread(begin, length)]]))
    return codes, words, counts


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    task, number = TaskContext.get().partitionId(), 0
    if task >> (63 - CHUNK_BITS - CODE_BITS):
        raise ValueError("too many tasks for the numbers of chunks; read the texts in fewer partitions")

    def written(lang: str) -> pa.RecordBatch:
        nonlocal number
        codes, words, counts = _words(pa.concat_arrays(held.pop(lang)))
        size.pop(lang)
        number += 1
        if number > 1 << CHUNK_BITS or len(words) >> CODE_BITS:
            raise ValueError("too much text in a task for the numbers of chunks; read the texts in more partitions")
        lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([task << CHUNK_BITS | number - 1], pa.int64()), pa.array([lang]), pa.array([_packed(codes)]), *lists], names=["chunk", "lang", "codes", "words", "counts"])

    for batch in batches:
        langs = batch["lang"].to_numpy(zero_copy_only=False)
        for lang in np.unique(langs):
            text = batch["text"].take(pa.array(np.flatnonzero(langs == lang)))
            _, offsets = utf8(text)
            for i, j in steps(offsets, CHUNK_BYTES):
                held.setdefault(lang, []).append(text.slice(i, j - i))
                size[lang] = size.get(lang, 0) + int(offsets[j] - offsets[i])
                if size[lang] >= CHUNK_BYTES:
                    yield written(lang)
        while sum(size.values()) >= 2 * CHUNK_BYTES:
            yield written(max(size, key=size.get))
    for lang in list(held):
        yield written(lang)


def _row(chunk: pa.Scalar, codes: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([_packed(codes)], pa.binary()), pa.array([items.astype(np.int64).tobytes()], pa.binary())], names=["chunk", "codes", "items"])


def _only(codes: np.ndarray, n: int, reply: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Codes, of n, that the reply (code, id) names, as numbers of their ids in order, and these ids; gaps for the others."""
    code, ids = (np.asarray(reply.values.field(name)) for name in ("code", "id"))
    order = np.argsort(ids)
    new = np.full(n + 1, -1, np.int32)  # the last is that of gaps
    new[code[order]] = np.arange(len(order))
    return _closed(new[codes]), ids[order]


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The relation of single words: a chunk's codes with the ids of its words by its reply."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield _row(batch["chunk"][k], *_only(_unpacked(batch["codes"][k]), len(batch["reply"][k]), batch["reply"][k]))


def _joined(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's relation merge-joined with itself by adjacent place: codes of the phrases of one word more, and of each its first words' id, its last words' id and count."""
    codes, items = _unpacked(batch["codes"][k]), np.frombuffer(batch["items"][k].as_buffer(), np.int64)
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    pair = codes[at].astype(np.int64)
    pair *= max(1, len(items))
    pair += codes[at + 1]
    known, found, counts = np.unique(pair, return_inverse=True, return_counts=True)
    joined = np.full(max(0, len(codes) - 1), -1, np.int32)
    joined[at] = found
    return joined, items[known // max(1, len(items))], items[known % max(1, len(items))], counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of one word more: (chunk, code, n, head, tail)."""
    for batch in batches:
        for k in range(batch.num_rows):
            _, head, tail, counts = _joined(batch, k)
            for i in range(0, len(counts), OUT_ROWS):
                j = min(i + OUT_ROWS, len(counts))
                columns = [np.full(j - i, batch["chunk"][k].as_py()), np.arange(i, j, dtype=np.int32), counts[i:j], head[i:j], tail[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "code", "n", "head", "tail"])


def _next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The relation of the phrases of one word more that a chunk's reply names."""
    for batch in batches:
        for k in range(batch.num_rows):
            codes, _, _, counts = _joined(batch, k)
            yield _row(batch["chunk"][k], *_only(codes, len(counts), batch["reply"][k]))


def single_words(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """A table of the words of at least so many occurrences (id, phrase, last, lang, n, f, heads, tails), and the relation of all words' occurrences."""
    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    chunks = staged(documents.select(text.alias("text"), lang.alias("lang")).mapInArrow(rested(_chunked), "chunk long, lang string, codes binary, words array<string>, counts array<long>"), "words")
    counts = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    total = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n"))
    words = staged(counts.select("lang", "word", "f", F.monotonically_increasing_id().alias("id")), "numbered-words")
    known = chunks.select("chunk", "lang", F.posexplode("words").alias("code", "word")).join(words, ["lang", "word"])
    replies = known.groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("reply"))  # a chunk's own words
    relation = staged(chunks.select("chunk", "codes").join(replies, "chunk").mapInArrow(rested(_first), RELATION), "occurrences-1")
    one = F.array("f")
    table = words.where(F.col("f") >= least).join(total, "lang").select("id", F.col("word").alias("phrase"), F.col("word").alias("last"), "lang", "n", "f", one.alias("heads"), one.alias("tails"))
    ready = staged(table, "phrases-1")
    dropped(chunks)
    dropped(words)
    return ready, relation


def longer(relation: DataFrame, length: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """From the relation of phrases one word shorter: a written table of the frequent phrases of this length in each chunk that has them (chunk, code, id, head, tail, f), and their relation."""
    found = relation.mapInArrow(rested(_counted), "chunk long, code int, n long, head long, tail long")
    same = W.partitionBy("head", "tail")
    # a phrase's id: where it stands in the first chunk that has it
    place = F.shiftleft("chunk", CODE_BITS).bitwiseOR(F.col("code").cast("long"))
    counted = found.withColumns({"f": F.sum("n").over(same), "id": F.min(place).over(same)}).where(F.col("f") >= least)
    kept = staged(counted.select("chunk", "code", "id", "head", "tail", "f"), f"frequent-{length}")
    if length == LONGEST:
        return kept, None
    replies = kept.groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("reply"))
    return kept, staged(relation.join(replies, "chunk").mapInArrow(rested(_next), RELATION), f"occurrences-{length}")


def phrase_tables(documents: DataFrame, least: int = LEAST) -> list[DataFrame]:
    """For each length from 1 to LONGEST the phrases (id, phrase, last word, lang, n, f) of at least so many occurrences, with the ids of the phrases of one word less that they begin (head) and end with (tail), and the numbers of occurrences of their first (heads) and last (tails) 1, 2, ... words."""
    table, relation = single_words(documents, least)
    tables = [table]
    for length in range(2, LONGEST + 1):
        kept, following = longer(relation, length, least)
        dropped(relation)
        relation = following
        begin = tables[-1].select(F.col("id").alias("head"), F.col("phrase").alias("begin"), "lang", "n", "heads")
        end = tables[-1].select(F.col("id").alias("tail"), "last", "tails")
        found = kept.groupBy("id").agg(*(F.first(c).alias(c) for c in ("head", "tail", "f")))  # alike in all chunks
        whole = found.join(begin, "head").join(end, "tail")
        f = F.array("f")
        tables.append(staged(whole.select("id", "head", "tail", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "lang", "n", "f", F.concat("heads", f).alias("heads"), F.concat("tails", f).alias("tails")), f"phrases-{length}"))
        dropped(kept)
    return tables


def _weakest(length: int) -> Column:
    """The cut with the lowest score, then the fewest words before it: (score, k, l, r)."""
    exact = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")

    def at(k: int) -> Column:
        l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(length - k - 1))  # noqa: E741
        score = F.call_function("div", (exact("f") * exact("n")) * F.lit(1000).cast("decimal(4,0)"), exact(l) * exact(r))
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.array(*map(at, range(1, length))))


def collocations(tables: list[DataFrame], top: int = TOP) -> DataFrame:
    """Each lang's first phrases of two words or more: by score, occurrences (both descending) and phrase.

    One that is part of a longer frequent phrase with as many occurrences is left out. It is enough to look at phrases
    of one word more: a phrase between two equally frequent ones is as frequent.
    """
    scored = []
    for length, table in enumerate(tables[1:], 2):
        if length < len(tables):
            larger = tables[length].select(F.explode(F.array("head", "tail")).alias("id"), F.col("f").alias("longest"))
            table = table.join(larger.groupBy("id").agg(F.max("longest").alias("longest")), "id", "left").where("longest is null or longest < f")
        scored.append(table.withColumn("w", _weakest(length)).select("lang", "phrase", F.col("f").alias("a"), "w.l", "w.r", "n", "w.score"))
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a lang's phrases are first ranked in parts, of which no more than top rows each can count
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = every.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
