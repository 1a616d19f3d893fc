"""I-Match fingerprints: terms, band and subsets by plain Python, order of the documents, likeness."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curvemill.llm import imatch
from curvemill.llm._common import U64, mix, utf8, words_of


def terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", low))


def number(term):
    return int(words_of(*utf8(pa.array([term])), lower=False)[0][0])


def by_hand(text, band):
    """The fingerprint as a list of integers."""
    mine = terms(text)
    kept = mine & band
    if len(kept) < imatch.LEAST_TERMS:
        kept = mine
    hashes = sorted(number(t) for t in kept) or [int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little")]
    level = math.floor(math.log2(len(hashes)))
    one = lambda x: int(mix(np.array([x], U64))[0])
    out = [level]
    for k in range(imatch.LEVELS):
        for s in range(imatch.SUBSETS):
            chosen = [h for h in hashes if (h * int(imatch._FACTOR[s]) + int(imatch._SHIFT[s])) % 2**64 < 2 ** (64 - level - k)]
            out.append(one(sum(one(h) for h in chosen) % 2**64) % 255 + 1 if chosen else 0)
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_fingerprints_against_plain_python(spark):
    texts = [*corpus(60), None, "", "  \n", "...", "One", "one two", "a " * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counted = collections.Counter(x for t in texts for x in terms(t))
    band = {t for t, n in counted.items() if math.exp(-imatch.MAX_IDF) * len(texts) <= n <= math.exp(-imatch.MIN_IDF) * len(texts)}
    words = imatch.lexicon(docs.repartition(3))
    assert sorted(map(number, band)) == words.tolist()
    got = {r.doc_id: list(bytes.fromhex(r.fingerprint)) for r in imatch.fingerprinted(docs.withColumn("fingerprint", F.lit(1)), words).collect()}
    assert got == {i: by_hand(t, band) for i, t in enumerate(texts)}


@pytest.mark.parametrize("range_rows", [1, 3, 8192])
def test_each_row_meets_its_next(spark, monkeypatch, range_rows):
    monkeypatch.setattr(imatch, "RANGE_ROWS", range_rows)
    texts = corpus(40)
    rows = [(i * 7 % 41, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again"), (None, "no id"), (None, "nor here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit(1), "at": F.lit("x"), "none": F.lit("y")}).repartition(4)
    numbers = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for d, t in rows if d is None}
    order = sorted(rows, key=lambda r: (r[0] is None, numbers[r[1]] if r[0] is None else r[0], r[1]))
    want = collections.Counter((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()) for (d, t), (_, u) in zip(order, order[1:] + order[:1]))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in imatch.edits(docs, imatch.lexicon(docs)).collect()) == want


def test_likeness(spark):
    texts = corpus(300, 8)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in imatch.edits(docs, imatch.lexicon(docs)).collect()}
    long = [i for i, t in enumerate(texts) if len(t.split()) >= 20]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())
    assert sum(rows[i].near_edited > rows[i].near_next for i in long) > 0.98 * len(long)
    share = lambda a, b: len(terms(a) & terms(b)) / len(terms(a) | terms(b))
    edited = lambda i: texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[(i + 1) % 300][: len(texts[i]) // 4]
    assert abs(np.mean([rows[i].near_edited - share(texts[i], edited(i)) for i in long])) < 0.1


def test_equal_texts_and_small_tables(spark, docs, empty):
    words = imatch.lexicon(docs)
    by_text = collections.defaultdict(set)
    for r in imatch.fingerprinted(docs, words).select("text", "fingerprint").collect():
        by_text[r.text or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len(imatch.lexicon(empty)) == 0 and imatch.edits(empty, words).count() == 0
    one = imatch.edits(docs.where("doc_id = 1"), words).collect()
    assert len(one) == 1 and one[0].near_next == 1
