"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm.oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm import langid

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(documents.where(~held_out))
    return langid.predict(documents.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.secret_scan import as_text, find_secrets

    found = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.near_dedup import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.suffix_dedup import dedup_substrings

    out = dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.chat import digests, format_chats

    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(given.unionByName(more)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from curvemill.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.decontam import find_benchmark

    found = find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.flac import digests, store

    return digests(store(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm import quality

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out)
    model = quality.fit(quality.sampled_rows(labels, documents))
    scored = quality.score(documents.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.window_dedup import dedup_windows

    return dedup_windows(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_setm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.setm import collocations, phrase_tables

    return collocations(phrase_tables(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.filter_audit import audit, masks

    return audit(masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curvemill.llm.imatch import edits, lexicon

    documents = _table(spark, sf_dir, "documents")
    return edits(documents, lexicon(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_secret_scan": op2_secret_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_packing": op6_packing,
    "op7_decontam": op7_decontam,
    "op8_flac": op8_flac,
    "op9_quality_knn": op9_quality_knn,
    "op10_window_dedup": op10_window_dedup,
    "op11_setm": op11_setm,
    "op12_filter_audit": op12_filter_audit,
    "op13_imatch": op13_imatch,
}
