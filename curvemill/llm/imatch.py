"""Document fingerprints by I-Match over many randomised lexicons.

Terms are runs of ASCII letters, digits and other bytes from 128 on, A-Z lower-cased. One pass counts in how many
documents each occurs; the lexicon holds those within a band of inverse document frequency (natural logarithm of
documents over documents with the term, from MIN_IDF to MAX_IDF). A document keeps its distinct terms of the lexicon in
sorted order. A classic fingerprint is one hash of them, which a single changed term upsets. Here SUBSETS randomised
subsets of the lexicon each get a hash of the kept terms that fall into them, and a subset is so sparse that a document
has one or two terms in it: level r takes each term with probability 2^-r, and a document with m kept terms uses
levels floor(log2 m) and the next one, so that its hashes can be compared with those of documents up to four times as
rich. ``likeness`` estimates the share of common among all terms of two documents from the subsets in which either has
a term, and those of them with equal hashes, at the level that both have; it is 0 for documents with no common level.

Size: terms above the band's lower end occur in at least exp(-MAX_IDF) of all documents, so there are no more of them
than the mean number of distinct terms in a document times exp(MAX_IDF), however large the corpus; at most
MAX_LEXICON, the most frequent first, are broadcast (8 MB).

A document with fewer than LEAST_TERMS terms of the lexicon keeps all of its terms, one without any term its whole text
as one. Equal texts have equal fingerprints. A null text is empty. Columns may have any names; extra ones are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import U64, mix, steps, utf8, words_of

#: The band of inverse document frequency, most terms of a lexicon, and least terms that make a fingerprint.
MIN_IDF, MAX_IDF, MAX_LEXICON, LEAST_TERMS = 1.6, 6.9, 1 << 20, 4
#: Randomised subsets of the lexicon, levels that a fingerprint holds.
SUBSETS, LEVELS = 64, 2
WIDTH = 1 + SUBSETS * LEVELS
#: Documents of a range of ids, most ranges, distinct terms that a task holds before it passes them on.
RANGE_ROWS, MAX_RANGES, HELD = 1 << 13, 1 << 17, 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [ord(c.lower()) if c.isalnum() else 32 for c in map(chr, range(128))]
_FACTOR, _SHIFT = np.random.default_rng(71).integers(0, 1 << 63, (2, SUBSETS), np.uint64) * U64(2) + U64(1)
#: A term is in a subset at level r if its number there is no more than this.
_REACH = np.array([(1 << (64 - r)) - 1 for r in range(64)], np.uint64)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of documents as (hash, document), sorted by document and hash."""
    base = offsets[0]
    hashes, _, _, first = words_of(_BYTES[data[base : offsets[-1]]], offsets - base, lower=False)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    terms, numbers, size = np.zeros(0, U64), np.zeros(0, np.int64), 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every, at = np.unique(np.concatenate([terms, *held]), return_inverse=True)
        total = np.bincount(at, np.concatenate([numbers, np.ones(len(at) - len(numbers), np.int64)]), len(every))
        return every, total.astype(np.int64)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(numbers)], names=["term", "n"])

    for given in batches:
        data, offsets = utf8(given.column(0))
        for i, j in steps(offsets):
            held.append(_terms(data, offsets[i : j + 1])[0])
            size += len(held[-1])
            if size >= HELD:
                (terms, numbers), held, size = merged(), [], 0
                if len(terms) >= HELD:
                    yield batch()
                    terms, numbers = terms[:0], numbers[:0]
    terms, numbers = merged()
    yield batch()


def lexicon(documents: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms of documents (text) within the band."""
    n = documents.count()
    counts = documents.select(F.col("text").cast("string")).mapInArrow(_counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where(F.col("n").between(math.exp(-MAX_IDF) * n, math.exp(-MIN_IDF) * n))
    rows = band.orderBy(F.desc("n"), "term").limit(MAX_LEXICON).select("term").toArrow()
    return np.sort(rows["term"].to_numpy().view(U64))


def fingerprints(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """Fingerprints of texts as rows of WIDTH bytes: the first level, then a hash for each subset (0: none of its terms), level by level."""
    data, offsets = utf8(texts)
    out = np.zeros((len(texts), WIDTH), np.uint8)
    for i, j in steps(offsets):
        n = j - i
        h, doc = _terms(data, offsets[i : j + 1])
        inside = words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h if len(words) else np.zeros(len(h), bool)
        used = inside | (np.bincount(doc[inside], minlength=n) < LEAST_TERMS)[doc]
        h, doc = h[used], doc[used]
        bare = np.flatnonzero(np.bincount(doc, minlength=n) == 0)
        if len(bare):
            whole = [int.from_bytes(hashlib.blake2b(data[offsets[i + k] : offsets[i + k + 1]].tobytes(), digest_size=8).digest(), "little") for k in bare]
            h, doc = np.concatenate([h, np.array(whole, U64)]), np.concatenate([doc, bare])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        level = np.log2(np.bincount(doc, minlength=n)).astype(np.int64)
        out[i:j, 0] = level
        reach = [_REACH[level + k][doc] for k in range(LEVELS)]
        for s in range(SUBSETS):
            number = h * _FACTOR[s] + _SHIFT[s]
            for k in range(LEVELS):
                chosen = np.flatnonzero(number <= reach[k])
                if len(chosen):
                    owner = doc[chosen]
                    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    total = mix(np.add.reduceat(mix(h[chosen].copy()), starts))  # of sorted, distinct terms
                    out[i + owner[starts], 1 + k * SUBSETS + s] = total % U64(255) + U64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each two fingerprints (rows of bytes): 0 to 1.

    With u terms in either document, c of them in one only, and a share q of terms in a subset, 1 - exp(-q u) of the
    subsets have a term and exp(-q c) - exp(-q u) have one and equal hashes; 1 - c / u follows from these shares.
    """
    top = np.maximum(a[:, 0], b[:, 0]).astype(np.int64)
    comparable = (top - a[:, 0] < LEVELS) & (top - b[:, 0] < LEVELS)
    rows = np.arange(len(a))[:, None]
    subset = np.arange(SUBSETS)[None, :]
    at = lambda x: x[rows, 1 + np.minimum(top - x[:, 0], LEVELS - 1)[:, None] * SUBSETS + subset]
    x, y = at(a), at(b)
    either = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x > 0) & (x == y)).sum(axis=1)
    without = np.clip(SUBSETS - either, 0.5, SUBSETS - 0.5) / SUBSETS
    value = 1 - np.log(np.minimum(without + same / SUBSETS, 1)) / np.log(without)
    return np.where(comparable, np.where(same == either, 1.0, np.clip(value, 0, 1)) * (same > 0), 0.0)


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in prints], pa.string())


def fingerprinted(documents: DataFrame, words: np.ndarray) -> DataFrame:
    """documents with a column fingerprint (hexadecimal digits) of their text, by the lexicon words; one of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("string")
    def made(text: pa.Array) -> pa.Array:
        return _hex(fingerprints(text, shared.value))

    return documents.withColumn("fingerprint", made(F.col("text").cast("string")))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (place, doc_id, text) of documents, sorted within partitions so that each document is followed by its next one.

    Order: by doc_id, those without one last, by a hash of their text; equal ids by text. The order is cut into ranges,
    each a partition, which ends with a copy of the next range's first document (the last range: of the first document
    of all); place is even for a range's own rows, odd for that copy.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"none": F.col("doc_id").isNull().cast("int"), "at": F.coalesce("doc_id", F.xxhash64("text"))})
    n = min(MAX_RANGES, documents.count() // RANGE_ROWS + 1)
    cut = rows.select("none", "at").repartitionByRange(n, "none", "at").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "at")).alias("first"))
    firsts = sorted((r["first"]["none"], r["first"]["at"]) for r in cut.collect())  # at most a row for each range
    known = np.array([at for none, at in firsts if not none], np.int64)
    unknown = np.array([at for none, at in firsts if none], np.int64)
    ranges = max(1, len(firsts))
    shared = documents.sparkSession.sparkContext.broadcast((known, unknown))

    @F.arrow_udf("array<int>")
    def places(none: pa.Array, at: pa.Array) -> pa.Array:
        known, unknown = shared.value
        key, lacks = at.to_numpy(zero_copy_only=False), none.to_numpy(zero_copy_only=False) == 1
        number = np.where(lacks, len(known) + np.searchsorted(unknown, key, side="right"), np.searchsorted(known, key, side="right")) - 1
        first = np.concatenate([known, unknown])[number] == key
        first &= lacks == (number >= len(known))
        values = np.stack([2 * number, 2 * ((number - 1) % ranges) + 1], axis=1)
        chosen = np.stack([np.ones(len(key), bool), first], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(chosen.sum(axis=1))]).astype(np.int32)), pa.array(values[chosen].astype(np.int32)))

    dealt = rows.withColumn("place", F.explode(places("none", "at")))
    return dealt.repartitionById(ranges, (F.col("place") / 2).cast("int")).sortWithinPartitions("place", "none", "at", "text").select("place", "doc_id", "text")


def edits(documents: DataFrame, words: np.ndarray) -> DataFrame:
    """For each of documents (doc_id, text): its fingerprint, that of its edited text, and how like its own they and the next document's are.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document's; order as in with_next. A lone document is its own next one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if carried is not None:
                batch = pa.concat_batches([carried, batch])
            carried = batch.slice(batch.num_rows - 1)
            _, offsets = utf8(batch["text"])
            for i, j in steps(offsets):
                part = batch.slice(i, j - i + 1)  # with one row more, the next of the last
                if part.num_rows > 1:
                    yield compared(part)

    def compared(part: pa.RecordBatch) -> pa.RecordBatch:
        place = part["place"].to_numpy()
        texts = [t or "" for t in part["text"].to_pylist()]
        prints = fingerprints(part["text"], shared.value)
        own = np.flatnonzero((place[:-1] % 2 == 0) & (place[1:] - place[:-1] <= 1))
        cut = [len(texts[k]) // 4 for k in own]
        edited = [texts[k][: len(texts[k]) - q] + texts[k + 1][:q] for k, q in zip(own, cut, strict=True)]
        changed = fingerprints(pa.array(edited, pa.string()), shared.value)
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        mine = prints[own]
        columns = [part["doc_id"].take(pa.array(own)), pa.array([len(texts[k]) for k in own], pa.int64()), pa.array(digest, pa.string()), _hex(mine), _hex(changed), pa.array(likeness(mine, changed)), pa.array(likeness(mine, prints[own + 1]))]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return with_next(documents).mapInArrow(run, SCHEMA)
