"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is its counts of hashed byte trigrams (of the whole text, case and punctuation included) and of words that repeat
the word before them, as log(1 + 1000 * share) times the term's rarity; the largest RANK singular directions of the
labelled sample turn that into a latent vector of unit length. The labelled vectors are broadcast; their number is
bounded by TRAIN_PER_LABEL for each label, whatever the input. Every document's cosines with all of them are computed
exactly in blocks; the NEIGHBOURS nearest vote, weighted by the eighth power of their similarity.

Texts that are null or empty have no direction and get the labels' mean; with no labels at all the score is 0.5.
Cosines are computed in double precision and rounded to six decimals, so that equal texts get equal scores wherever in a
block they stand, and neighbours that are equally near are ties; these go to the first in the sample's order. Extra
columns are kept, but score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import spread, steps, utf8, words_of
from curvemill.llm._features import byte_grams, gram_docs

#: Bound of the labelled sample, terms, directions, voters, documents whose cosines are computed at once.
TRAIN_PER_LABEL, BITS, RANK, NEIGHBOURS, BLOCK = 1000, 12, 64, 15, 256
TERMS = (1 << BITS) + 1
#: Weight of the share of repeated words beside hundreds of trigrams.
REPEAT_WEIGHT = 10


def term_weights(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + 1000 * share) of each term (the last: repeated words), a row for each document."""
    n = len(offsets) - 1
    starts, counts = gram_docs(offsets, 3)
    grams = byte_grams(data[offsets[0] : offsets[-1]], 3, BITS)
    keep = spread(starts, counts)
    doc = np.repeat(np.arange(n), counts)
    table = np.bincount(doc * TERMS + grams[keep], minlength=n * TERMS).reshape(n, TERMS).astype(np.float32) if len(keep) else np.zeros((n, TERMS), np.float32)
    table /= np.maximum(counts, 1)[:, None]
    hashes, _, _, first = words_of(data, offsets, lower=False)
    again = np.concatenate([[0], hashes[1:] == hashes[:-1]]) if len(hashes) else np.zeros(0)
    total = np.concatenate([[0], np.cumsum(again)])
    words = np.diff(first)
    table[:, -1] = np.maximum(total[first[1:]] - total[np.minimum(first[:-1] + 1, first[1:])], 0) / np.maximum(words, 1)
    table = np.log1p(1000 * table)
    table[:, -1] *= REPEAT_WEIGHT
    return table


class Model:
    def __init__(self, weights: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.rarity = np.log((1 + len(weights)) / (1 + (weights > 0).sum(axis=0))).astype(np.float32) + 1
        rows = weights * self.rarity
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        rank = min(RANK, *rows.shape)
        # randomised range finder with two power iterations
        basis = np.linalg.qr(rows.T @ np.random.default_rng(5).standard_normal((len(rows), min(rank + 10, len(rows)))).astype(np.float32))[0]
        for _ in range(2):
            basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
        _, _, directions = np.linalg.svd(rows @ basis, full_matrices=False)
        self.directions = (basis @ directions[:rank].T).astype(np.float32)
        self.vectors = self._unit(weights)

    def _unit(self, weights: np.ndarray) -> np.ndarray:
        latent = (weights * self.rarity).astype(np.float64) @ self.directions.astype(np.float64)
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def score(self, weights: np.ndarray) -> np.ndarray:
        cosine = np.round(np.maximum(self._unit(weights) @ self.vectors.T, 0), 6)
        k = min(NEIGHBOURS, len(self.labels))
        n = len(self.labels)
        place = np.rint(cosine * 1e6).astype(np.int64) * n + np.arange(n)[::-1]
        near = np.sort(np.argpartition(-place, k - 1, axis=1)[:, :k], axis=1)
        weight = np.take_along_axis(cosine, near, axis=1) ** 8
        total = weight.sum(axis=1)
        voted = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-12, voted, self.labels.mean())


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        for k in range(batch.num_rows):
            row = term_weights(data, offsets[k : k + 2])[0]
            index = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(k, 1), batch["label"].slice(k, 1), pa.array([index.astype(np.int32).tobytes()], pa.binary()), pa.array([row[index].tobytes()], pa.binary())], names=["doc_id", "label", "index", "weight"])


def sampled_rows(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text, label) of about TRAIN_PER_LABEL labelled documents for each label 0 and 1, chosen by hash from labels (doc_id, label)."""
    rows = labels.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 0, TRAIN_PER_LABEL / max(1, counts.get(0, 1))).otherwise(TRAIN_PER_LABEL / max(1, counts.get(1, 1)))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < share * 1_000_000)
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(chosen), "doc_id")  # at most about 2 * TRAIN_PER_LABEL ids


def fit(labelled: DataFrame) -> Model | None:
    """A model from a bounded sample of rows (doc_id, text, label 0 or 1), as sampled_rows gives; None if there are none."""
    found = labelled.mapInArrow(_vectors, "doc_id string, label int, index binary, weight binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.doc_id, bytes(r["index"]), r.label))
    weights = np.zeros((len(found), TERMS), np.float32)
    for k, r in enumerate(found):
        weights[k, np.frombuffer(r["index"], np.int32)] = np.frombuffer(r.weight, np.float32)
    return Model(weights, np.array([r.label for r in found]))


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents with score: how much of the neighbours' weight has label 1."""
    if model is None:
        return documents.withColumn("score", F.lit(0.5))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def vote(text: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        out = []
        for i, j in steps(offsets):
            for a in range(i, j, BLOCK):
                out.append(shared.value.score(term_weights(data, offsets[a : min(a + BLOCK, j) + 1])))
        return pa.array(np.clip(np.concatenate([*out, np.zeros(0)]), 0, 1).astype(np.float64))

    return documents.withColumn("score", vote(F.col("text").cast("string")))
