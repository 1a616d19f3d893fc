"""The registered queries themselves, on small tables: contract columns, a row for each document, and brute force where it is quick."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from curvemill.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_langid": ("doc_id", "held_out", "lang_pred", "score"),
    "op2_secret_scan": ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"),
    "op3_near_dedup": ("doc_id", "n_shingles", "component_id", "kept"),
    "op4_suffix_dedup": ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
    "op5_chat_format": ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"),
    "op6_packing": ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"),
    "op7_decontam": ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
    "op8_flac": ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"),
    "op9_quality_knn": ("doc_id", "held_out", "score", "predicted"),
    "op10_window_dedup": ("doc_id", "n_words", "n_removed", "kept_sha256"),
    "op11_setm": ("lang", "rank", "phrase", "a", "l", "r", "n", "score"),
    "op13_imatch": ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"),
    "op12_filter_audit": ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"),
}


@pytest.fixture(scope="module")
def sf_dir(spark, docs, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    known = [t for _, t in texts if t and len(t.split()) > 60]
    items = [(7, " ".join(known[0].split()[4:20])), (8, "nowhere to be found in any of these small texts"), (9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "user", "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, items


def test_all_are_registered():
    assert QUERIES.keys() == COLUMNS.keys() and ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, sf_dir, texts, name):
    folder, items = sf_dir
    found = QUERIES[name](spark, folder)
    assert tuple(found.columns)[: len(COLUMNS[name])] == COLUMNS[name]
    rows = {r[0]: tuple(r[1:]) for r in found.collect()}
    if name == "op11_setm":
        langs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect())
        assert {tuple(r) for r in found.collect()} == brute.collocations([(t, langs[i]) for i, t in texts], 100)
        return
    if name == "op12_filter_audit":
        assert found.count() == 3 * 600
        return
    if name == "op5_chat_format":
        assert rows.keys() == {-1, 1, 2} and rows[-1][0] == 2
        return
    assert rows.keys() == {i for i, _ in texts}
    if name == "op3_near_dedup":
        assert rows == brute.near(texts)
    if name == "op4_suffix_dedup":
        assert rows == brute.substrings(texts)
    if name == "op7_decontam":
        assert rows == brute.contaminated(texts, items)
    if name == "op13_imatch":
        assert {i: r[:2] for i, r in rows.items()} == brute.edited(texts)
    if name == "op10_window_dedup":
        assert rows == brute.windows(texts)
