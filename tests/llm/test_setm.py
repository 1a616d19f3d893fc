"""Collocations against plain counting."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from curvemill.llm import setm


def corpus(rng, n):
    vocabulary = ["of", "The", "a", "in", "über", "x", "é\x01", "state", "machine", "red", "RED"]
    phrases = ["support vector machine", "new york city is big", "x x x x x x", "of the", "a\tstate of the art"]
    some = lambda: rng.choice(phrases) if rng.random() < 0.3 else rng.choice(vocabulary)
    return [(rng.choice([" ", "  ", "\t"]).join(some() + rng.choice(["", "", "", ",", ".\n", "!?", "\x0c", " "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "top"), [(1, 2000), (700, 2000), (6 << 20, 2000), (700, 7)])
def test_against_plain_counting(spark, monkeypatch, chunk, top):
    monkeypatch.setattr(setm, "CHUNK_BYTES", chunk)
    rows = [*corpus(random.Random(5), 120), (None, "en"), ("", None), (" . , ", "fr"), ("One word", "it"), ("machine " * 3000, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"chunk": F.lit(1), "f": F.lit("f"), "w": F.lit(0), "ids": F.lit("i"), "words": F.lit("z")}).repartition(3)
    got = [tuple(r) for r in setm.collocations(setm.phrase_tables(docs, least=6), top).collect()]
    want = brute.collocations(rows, 6, top=top)
    assert len(got) == len(want) and set(got) == want and len(want) > 10


def test_nothing_is_frequent(spark):
    docs = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert setm.collocations(setm.phrase_tables(docs)).count() == 0
    assert setm.collocations(setm.phrase_tables(docs.limit(0))).count() == 0


def test_products_past_64_bits(spark):
    big = 3_000_000_000_000
    row = [(1, "a b", "b", "en", 5 * big, big, [big + 7, big], [big + 9, big])]
    table = spark.createDataFrame(row, "id long, phrase string, last string, lang string, n long, f long, heads array<long>, tails array<long>")
    assert setm.collocations([table.limit(0), table]).first()["score"] == 1000 * big * 5 * big // ((big + 7) * (big + 9))
