"""The filter audit against plain Python that applies the filters one after another."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from curvemill.llm.filter_audit import audit, masks

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id long, quality int, toxic int"


def by_hand(rows, labels):
    """rows (doc_id, text, source) to {(part, order, step): counts}."""
    marks = collections.defaultdict(lambda: [0, 0])
    for doc, quality, toxic in labels:
        if doc is not None:
            marks[doc] = [max(marks[doc][0], int(quality == 1)), max(marks[doc][1], int(toxic == 1))]
    last = float("inf")
    least = {}
    for doc, text, _ in rows:
        key = last if doc is None else doc
        least[text or ""] = min(least.get(text or "", last), key)
    parts = collections.defaultdict(list)
    for doc, text, source in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": (last if doc is None else doc) > least[t]}
        parts[source or ""].append(({k for k, v in fails.items() if v}, *(marks[doc] if doc is not None else (0, 0))))
    out = {}
    for part, docs in parts.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            here = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in here if f in d[0]]
                before = [d for d in docs if f in d[0] and d not in here]
                here = [d for d in here if f not in d[0]]
                total[f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                out[part, "".join(order), step] = [len(here), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                assert len(before) <= failing
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def rows_of():
    long = " ".join(f"word{i}" for i in range(250))
    return [(1, long, "a"), (2, long, "a"), (3, "SHOUT " * 30, "a"), (4, None, "a"), (5, "", None), (6, "", ""), (7, long + " #", "b"), (7, long + " #", "b"), (None, long, "b"), (None, "x $ y", None), (8, "same " * 220, "b"), (9, long.upper(), "c"), (10, "é\x0b" * 210, "c"), (11, "é é " * 300, "c")]


def test_against_plain_python(spark):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (8, None, None), (9, 1, None)]
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string, source string").withColumns({"mask": F.lit("m"), "part": F.lit(5), "labelled": F.lit(1), "digest": F.lit("d")})
    found = audit(masks(docs.repartition(3), spark.createDataFrame(labels, LABELS))).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in found}
    assert len(found) == len(got) == 4 * 600 and got == by_hand(rows_of(), labels)


def test_many_parts_and_copies(spark):
    rows = [(i, "the same text " * (i % 3), f"s{i % 40}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in audit(masks(docs, spark.createDataFrame([], LABELS))).collect()}
    assert got == by_hand(rows, [])


@pytest.mark.parametrize("source", ["x", None])
def test_empty_tables(spark, source):
    docs = spark.createDataFrame([(1, "t", source)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], LABELS)
    assert audit(masks(docs.limit(0), none)).count() == 0
    assert audit(masks(docs, none)).where("step = 1 and filter_order = 'ABCDE'").select("part", "removed").collect() == [(source or "", 1)]
