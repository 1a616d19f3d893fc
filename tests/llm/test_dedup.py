import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from curvemill.llm import _repeats, near_dedup, suffix_dedup, window_dedup


def rows_of(df, *names):
    return {r[0]: tuple(r[1:]) for r in df.select(*names).collect()}


def substring_rows(docs):
    out = suffix_dedup.dedup_substrings(docs)
    return rows_of(out, "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("k"))


def test_substrings_against_brute_force(docs, texts):
    assert substring_rows(docs) == brute.substrings(texts)


def test_hot_groups_are_compared_window_by_window(docs, texts, monkeypatch):
    # executors import the module anew, so the limit is set where the task runs
    group = _repeats._compared

    def tiny(*args):
        run = group(*args)

        def with_limit(batches):
            from curvemill.llm import _repeats as inside

            inside.HOT = 1
            try:
                yield from run(batches)
            finally:
                inside.HOT = 20_000

        return with_limit

    monkeypatch.setattr(_repeats, "_compared", tiny)
    assert substring_rows(docs) == brute.substrings(texts)
    assert rows_of(window_dedup.dedup_windows(docs), "doc_id", "n_words", "n_removed", F.sha2("kept", 256)) == brute.windows(texts)


def test_windows_against_brute_force(docs, texts):
    assert rows_of(window_dedup.dedup_windows(docs), "doc_id", "n_words", "n_removed", F.sha2("kept", 256)) == brute.windows(texts)


def window_rows(docs):
    return rows_of(window_dedup.dedup_windows(docs), "doc_id", "n_words", "n_removed", F.sha2("kept", 256))


def test_windows_with_a_full_sketch(docs, texts, monkeypatch):
    monkeypatch.setattr(window_dedup, "likely", lambda sketch, prints, replies: np.ones(len(prints), bool))
    assert window_rows(docs) == brute.windows(texts)


def test_windows_of_many_chunks_and_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(window_dedup, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(window_dedup, "BLOCK_CELLS", 1 << 14)
    sketch = window_dedup.Sketch.of(300_000)
    assert sketch.chunks > 50 and sketch.block_bits > 3
    assert window_rows(docs) == brute.windows(texts)


def test_window_workers_give_memory_back(monkeypatch):
    """A worker that keeps a chunk's arrays holds them through all later stages."""
    given, sketch, dealt = [], window_dedup.Sketch.of(100_000), [" ".join(f"w{i % 60}" for i in range(k, k + 90)) for k in range(3)]
    monkeypatch.setattr(window_dedup, "rest", lambda: given.append(1), raising=False)
    texts = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": dealt, "dkey": pa.array([1, 2, 3], pa.int64())})
    sent = list(window_dedup._partition_sketch(sketch)((pa.scalar(0),), iter(texts.to_batches())))
    told = list(window_dedup._merge(sketch)((pa.scalar(0),), iter(sent)))
    rows = window_dedup._candidates(sketch)(texts, pa.Table.from_batches(told, schema=window_dedup._REPLY))
    assert rows.num_rows and len(given) == 3
    decided = rows.filter(pc.equal(rows["kind"], _repeats.DECIDED))
    kept = window_dedup._cut(texts, decided)
    assert kept["n_removed"].to_pylist() == [0, 89, 89] and len(given) == 4


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    sketch = window_dedup.Sketch.of(6 * 400_000)
    chunks = [rng.integers(0, 1 << 64, 100_000, np.uint64) for _ in range(4)]
    shared = chunks[0][:500]
    chunks[3][:500] = shared
    total = np.zeros((window_dedup.DEPTH, 1 << sketch.bits), np.int64)
    for prints in chunks:
        for row in range(window_dedup.DEPTH):
            cells = np.unique(sketch.cells(prints, row))
            sent = window_dedup.packed(cells)
            assert (window_dedup.unpacked(*sent) == cells).all()
            total[row, cells] += 1
    for prints in chunks:
        replies = {}
        for row in range(window_dedup.DEPTH):
            cells = np.unique(sketch.cells(prints, row))
            block = sketch.blocks(cells)
            for b in np.unique(block).tolist():
                replies[row, b] = np.packbits(total[row, cells[block == b]] > 1).tobytes()
        keep = window_dedup.likely(sketch, prints, replies)
        assert keep[np.isin(prints, shared)].all()
        assert keep[~np.isin(prints, shared)].mean() < 0.015
    for cells in ([], [3], [0, 65535, 65536, 200_000], [1 << 22, 1 << 23]):
        assert window_dedup.unpacked(*window_dedup.packed(np.array(cells, np.int64))).tolist() == cells


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(docs, texts, words, percent):
    found = rows_of(near_dedup.near_duplicates(docs, words, percent), "doc_id", "n_shingles", "component_id", F.expr("doc_id = component_id"))
    assert found == brute.near(texts, words, percent)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(w if i != k % 55 else f"other{k}" for i, w in enumerate(base))) for k in range(30)]
    found = rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85), "doc_id", "n_shingles", "component_id", F.expr("doc_id = component_id"))
    assert found == brute.near(rows)


@pytest.mark.parametrize("run", [suffix_dedup.dedup_substrings, window_dedup.dedup_windows, near_dedup.near_duplicates])
def test_empty_table(empty, run):
    assert run(empty).count() == 0


def test_null_ids_and_repeated_rows(spark, texts):
    long = next(t for _, t in texts if t and len(t) > 400)
    rows = [(None, long), (None, long), (3, long), (3, long), (9, long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    removed = sorted((r.doc_id or 0, r.n_bytes - len(r.kept)) for r in suffix_dedup.dedup_substrings(frame).collect())
    size = len(long.encode())
    inner = brute.substrings([(0, long)])[0][1]
    assert removed == [(0, 0), (0, 0), (3, inner), (3, inner), (9, size)]
    near = sorted((r.doc_id or 0, r.component_id or 0) for r in near_dedup.near_duplicates(frame).collect())
    assert near == [(0, 0), (0, 0), (3, 3), (3, 3), (9, 3)]


def test_intervals_of_common_prefixes():
    assert list(suffix_dedup.intervals([2, 1])) == [(0, 2, 2, 1), (0, 3, 1, 0)]
    assert list(suffix_dedup.intervals([0, 3, 3])) == [(1, 4, 3, 0)]
    assert suffix_dedup.common(b"abcd", b"abxd") == 2
    assert suffix_dedup.common(b"abc", b"abcd") == 3


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one.upper()} {tail.upper()} x"), (4, f"{one} " * 60), (5, f"{other} " * 60), (6, f"{one} {other} {one}"), (7, f"{other} {one} {other}"), (8, f"{one[:40]} x"), (9, f"{other[:40]} x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(window_dedup.dedup_windows(frame), "doc_id", "n_words", "n_removed", F.sha2("kept", 256)) == brute.windows(rows)
    near = rows_of(near_dedup.near_duplicates(frame, 3, 85), "doc_id", "n_shingles", "component_id", F.expr("doc_id = component_id"))
    assert near == brute.near(rows)


def test_one_id_with_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    frame = spark.createDataFrame([(5, a), (5, b), (7, a + " more"), (8, b), (9, "c d e f")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame, 3, 85).select("doc_id", "component_id").collect())
    assert got == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_large_buckets_of_several_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):  # a chain: each differs from the one before in a few words, far ends in many
        rows.append((k, " ".join([*(f"new{i}" for i in range(2 * k)), *base[2 * k :]])))
    found = rows_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85), "doc_id", "n_shingles", "component_id", F.expr("doc_id = component_id"))
    assert found == brute.near(rows)
