"""Hierarchical language identification: the family first, then languages of it against each other.

A text is its relative frequencies of hashed byte trigrams, of the whole text, with everything but letters taken as a
space. A linear support vector machine for each family against the rest picks the family; within it one for each pair
of languages votes, so that closely related languages are only ever separated from each other. A new language needs
an entry in FAMILIES only if it has close relatives; else it is a family of its own.

The classifiers are fitted on about TRAIN_PER_LANGUAGE texts of each language, taken by a hash of doc_id from all that
qualify. Null texts and texts without a letter are "und" with score 0; with no labelled rows at all, so is every text.
Ties go to the first name. Repeated rows get equal results; extra columns are kept, but lang_pred and score replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import STEP_BYTES, fresh, spread, steps, utf8
from curvemill.llm._features import byte_grams, gram_docs

#: Bound of the labelled sample, length and hash bits of grams, penalty and rounds of the fit.
TRAIN_PER_LANGUAGE, GRAM, BITS, PENALTY, ROUNDS = 800, 3, 15, 10.0, 12
#: Families of languages that have close relatives, by their codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Letters of ASCII in lower case and all bytes beyond ASCII as they are, everything else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _folded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes().translate(_FOLD), np.uint8)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    out = np.zeros(len(offsets) - 1, bool)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[k] = any(map(str.isalpha, data[a:b].tobytes().decode("utf8", "replace")))
    return out


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, dim: int) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with hinge loss, by dual coordinate descent over sparse rows."""
    weights, alpha, order = np.zeros(dim + 1), np.zeros(len(rows)), np.random.default_rng(1)
    square = np.array([v @ v + 1 for _, v in rows])
    # classes weigh alike, however many rows each has
    most = np.where(sign > 0, PENALTY * len(rows) / (2 * max(1, (sign > 0).sum())), PENALTY * len(rows) / (2 * max(1, (sign < 0).sum())))
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)):
            index, values = rows[i]
            slope = sign[i] * (weights[index] @ values + weights[dim]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[index] += step * values
                weights[dim] += step
                alpha[i] = new
    return weights


class Model:
    """names of families; rows of weights: one for each family against the rest, then one for each pair within a family."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.languages = sorted({r[0] for r in rows})
        family = {x: FAMILY_OF.get(x, x) for x in self.languages}
        self.families = sorted(set(family.values()))
        self.members = [[x for x in self.languages if family[x] == f] for f in self.families]
        self.pairs = [[(a, b) for a in range(len(m)) for b in range(a)] for m in self.members]
        self.scale = 1 / max(1e-9, float(np.mean([np.sqrt((v**2).sum()) for _, _, v in rows]))) if rows else 1.0
        scaled = [(i, v * self.scale) for _, i, v in rows]
        named = np.array([r[0] for r in rows])
        owner = np.array([family[r[0]] for r in rows])
        fitted = [fit_svm(scaled, np.where(owner == f, 1.0, -1.0), 1 << BITS) for f in self.families] if len(self.families) > 1 else [np.zeros((1 << BITS) + 1) for _ in self.families]
        for members, pairs in zip(self.members, self.pairs, strict=True):
            for a, b in pairs:
                some = np.flatnonzero((named == members[a]) | (named == members[b]))
                fitted.append(fit_svm([scaled[k] for k in some], np.where(named[some] == members[a], 1.0, -1.0), 1 << BITS))
        table = np.array(fitted).reshape(-1, (1 << BITS) + 1)
        self.weights, self.bias = (table[:, :-1] * self.scale).astype(np.float32), table[:, -1]

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """All classifiers' margins for the documents of a step."""
        starts, counts = gram_docs(offsets, GRAM)
        out = np.repeat(self.bias[:, None], len(counts), axis=1)
        grams = byte_grams(_folded(data, offsets), GRAM, BITS)
        some = np.flatnonzero(counts)
        if len(some):
            grams = grams[spread(starts[some], counts[some])]
            at = np.cumsum(counts[some]) - counts[some]
            for k, w in enumerate(self.weights):
                out[k, some] += np.add.reduceat(w[grams], at, dtype=np.float64) / counts[some]
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margins = self.margins(data, offsets)
        n = margins.shape[1]
        sure = 1 / (1 + np.exp(-2 * np.clip(margins, -20, 20)))
        which = margins[: len(self.families)].argmax(axis=0)
        score = sure[which, np.arange(n)] if len(self.families) > 1 else np.ones(n)
        lang, at = np.empty(n, object), len(self.families)
        for f, (members, pairs) in enumerate(zip(self.members, self.pairs, strict=True)):
            mine = np.flatnonzero(which == f)
            votes, least = np.zeros((len(members), len(mine))), np.ones((len(members), len(mine)))
            for k, (a, b) in enumerate(pairs):
                p = sure[at + k, mine]
                votes[a] += p > 0.5
                votes[b] += p <= 0.5
                least[a], least[b] = np.minimum(least[a], p), np.minimum(least[b], 1 - p)
            best = (votes + least / 2).argmax(axis=0) if len(mine) else np.zeros(0, int)
            lang[mine] = np.array(members, object)[best]
            score[mine] *= least[best, np.arange(len(mine))]
            at += len(pairs)
        return lang, score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch["text"])
        out = []
        for k in range(batch.num_rows):
            index, count = np.unique(byte_grams(_folded(data, offsets[k : k + 2]), GRAM, BITS), return_counts=True)
            out.append((index.astype(np.int32).tobytes(), (count / max(1, count.sum())).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["lang", "index", "share"])


def fit(labelled: DataFrame) -> Model | None:
    """A model from labelled rows (doc_id, text, lang); None if there are none. Uses about TRAIN_PER_LANGUAGE rows of each language, chosen by hash."""
    rows = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, TRAIN_PER_LANGUAGE / n)))), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000)
    found = sample.mapInArrow(_vectors, "lang string, index binary, share binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r["index"]), bytes(r.share)))  # whatever order the tasks ended in
    return Model([(r.lang, np.frombuffer(r["index"], np.int32), np.frombuffer(r.share, np.float32).astype(np.float64)) for r in found])


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """documents with lang_pred and score."""
    if model is None:
        return documents.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(text: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        langs, scores = [], []
        for i, j in steps(offsets, STEP_BYTES // 2):
            lang, score = shared.value.predict(data, offsets[i : j + 1])
            letter = has_letter(data, offsets[i : j + 1])
            langs += [x if y else "und" for x, y in zip(lang, letter, strict=True)]
            scores.append(np.where(letter, score, 0.0))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], names=["lang_pred", "score"])

    (name,) = fresh(documents, "guess")
    kept: list[Column] = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    return documents.withColumn(name, guess(F.col("text").cast("string"))).select(*kept, f"{name}.lang_pred", f"{name}.score")
