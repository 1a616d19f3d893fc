import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_text import check_packed

import corpus_pipeline
from curvemill.llm import decontam, langid, secret_scan

KEY = "password=abcdefghij0123456789"


@pytest.fixture(scope="module")
def sf_dir(spark, docs, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    known = [t for _, t in texts if t and len(t.split()) > 60]
    more = spark.createDataFrame([(1000, f"Some words {KEY} and more words", "en", "s", 1), (1001, "12 34 !!", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    items = [(7, " ".join(known[0].split()[4:20])), (8, "nowhere to be found in any of these small texts at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_stages_against_brute_force(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, items = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "secrets", "pack"]

    def after(stage, docs):
        out = corpus_pipeline.STAGES[stage][1](spark, docs, folder).cache()
        if stage < 4:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        return out, ({r.doc_id: r.text for r in out.collect()} if stage < 4 else None)

    docs, found = after(0, docs)
    rows = {d: t for d, t in rows.items() if any(map(str.isalpha, t or ""))}
    assert found == rows and 1001 not in rows

    docs, found = after(1, docs)
    kept = brute.near(rows.items(), 5, 80)
    rows = {d: t for d, t in rows.items() if kept[d][2]}
    assert found == rows and len(rows) < len(kept)

    docs, found = after(2, docs)
    bad = brute.contaminated(rows.items(), items)
    rows = {d: t for d, t in rows.items() if not bad[d][4]}
    assert found == rows and len(rows) < len(bad)

    docs, found = after(3, docs)
    assert found[1000] == "Some words [SECRET] and more words"
    clean = {d: t for d, t in rows.items() if d != 1000 and not re.search(secret_scan.HEX, t)}
    assert {d: found[d] for d in clean} == clean and found.keys() == rows.keys()
    assert not any(re.search(secret_scan.HEX, t) for t in found.values())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in found.items()}
    check_packed(after(4, docs)[0].collect(), ids)


def test_run_writes_and_reads_each_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir[0])
    assert rows.select("sequence_id").distinct().count() > 0
    assert {1001} & {r.doc_id for r in rows.select("doc_id").collect()} == set()


def test_language_stage_uses_the_prediction(spark, sf_dir, monkeypatch):
    folder, _ = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.where("lang is null").count() == 0 and docs.where("lang is null and text rlike '[a-z]'").count() > 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, folder).count() == kept.count()
    model = langid.fit(docs)
    french = {r.doc_id for r in langid.predict(docs, model).where("lang_pred = 'fr'").collect()}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", frozenset({"fr"}))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, folder).collect()} == french


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (3, "x y"), (3, "x y"), (None, "q r"), (None, "q r"), (4, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()))
    assert got == [(0, "q r"), (1, text), (3, "x y"), (4, "")]


@pytest.mark.parametrize("block_words", [2_000_000, 12])
def test_decontamination_judges_each_row_by_its_text(spark, tmp_path, monkeypatch, block_words):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontam, "CLEAN_DOCS", 3)
    passage, other = (" ".join(f"{w}{i}" for i in range(12)) for w in ("item", "two"))
    spark.createDataFrame([(1, passage), (2, other), (None, "lone item"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"bad {passage}"), (1, "clean"), (None, f"{passage} bad"), (2, "clean too"), (None, "clean"), (1, f"bad {passage}"), (3, None), (3, ""), (5, f"x {other} y"), (6, "a lone item here"), *((i, f"text {i}") for i in range(10, 30))]
    frame = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_hit", F.lit(1))
    kept = corpus_pipeline.decontaminate(spark, frame.repartition(2), str(tmp_path))
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    bad = lambda t: any(x in (t or "") for x in (passage, other, "lone item"))
    key = lambda r: (str(r[0]), r[1] or "\0" if r[1] is None else r[1])
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(((i, t) for i, t in rows if not bad(t)), key=key)


def test_stages_with_null_and_shared_ids(spark, tmp_path):
    spark.createDataFrame([(1, "nothing of the kind is anywhere to be found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"wort{i}" for i in range(30))
    rows = [(None, f"eins {KEY} zwei"), (None, "drei vier"), (1, "eins zwei"), (1, f"{KEY} drei"), (2, long), (2, long), (None, None)]
    frame = spark.createDataFrame([(i, t, None if i == 1 else "de", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda stage: sorted((r.text or "") for r in stage(spark, frame, str(tmp_path)).collect())
    given = sorted(t or "" for _, t in rows)
    assert texts(corpus_pipeline.language_id) == [t for t in given if t]
    assert texts(corpus_pipeline.decontaminate) == given
    assert texts(corpus_pipeline.secrets) == sorted(t.replace(KEY, "[SECRET]") for t in given)
    assert texts(corpus_pipeline.near_duplicates) == sorted(set(given))
    packed = corpus_pipeline.pack(spark, frame, str(tmp_path))
    assert packed.where("start = 0").count() == len(rows)


def test_packed_steps_are_equal_over_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.packing, "STEP_TOKENS", 4096)
    frame = spark.createDataFrame([(i, " ".join(f"wort{j}" for j in range(i % 700)), "de", "s", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    tokens, tasks = {}, set()
    for r in corpus_pipeline.pack(spark, frame.repartition(5), str(tmp_path)).collect():
        tokens[r.step_id] = tokens.get(r.step_id, 0) + r.length
        tasks.add(r.sequence_id >> 32)
    last = len(tokens) - 1
    assert last > 0 and len(tasks) == 5 and sorted(tokens) == list(range(last + 1))
    assert {tokens[k] for k in range(last)} == {4096} and 0 < tokens[last] <= 4096
