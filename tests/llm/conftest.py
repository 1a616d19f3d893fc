import random

import pytest

#: Columns that clash with names used inside the operators.
CLASHING = {"dkey": 1, "ranges": "x", "score": 0.5, "lang_pred": "xx", "spans": "s", "base": "b", "text2": "t", "key": 3, "id": 4, "root": 5, "bands": 6, "_guess": 7, "Score2": 8, "_text": "u", "_hex": "h", "place": 9, "chunk": 10, "component": 11, "high": 12}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Small texts with copies, near copies, shared passages, ties, nulls, white space only and one long text."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 160)) for _ in range(12)]
    passage = words(rng, 70)
    out = [*base, base[3], base[3], base[5].upper(), None, "", " \n\t ", "x", "x y", "x y", "ab" * 300, "ab" * 300, "z " * 400, "é" * 250]
    out += [" ".join(w if rng.random() > 0.01 else "new" for w in base[k].split()) for k in (1, 2, 7) for _ in range(3)]
    out += [f"{words(rng, 9)} {passage}\n{words(rng, 20)}", f"{passage} {words(rng, 5)}", f"{words(rng, 30)} {passage}", f"{passage} {passage}"]
    out.append(words(rng, 30_000))
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    langs = ["en", "fr", "de", "es", None]
    rows = [(i, t, rng.choice(langs), f"src{i % 3}", len(t) if t else 0) for i, t in texts]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({k: F.lit(v) for k, v in CLASHING.items()}).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < 0")
