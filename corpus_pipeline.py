"""A corpus pipeline of five stages; each reads what the one before wrote and returns the columns of documents, but the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm import decontam, langid, near_dedup, packing, secret_scan
from curvemill.llm._common import dropped, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows that Spark sends to a Python worker at once. Its own default, 10,000, makes buffers of tens of megabytes from texts, on both sides and for each task.
BATCH_ROWS = 2000


def _bounded(spark: SparkSession) -> None:
    """Small batches of texts, unless the session asks for a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Languages that stay, by predicted code; None: all that the labelled rows teach.
LANGUAGES: frozenset[str] | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, or no letter at all) and those whose predicted language isn't in LANGUAGES; a missing lang becomes the predicted one.

    The model learns from the docs' own lang column. Where no row has one there is no model, and texts with a letter stay.
    """
    _bounded(spark)
    if (model := langid.fit(docs)) is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    guessed = langid.predict(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    if LANGUAGES is not None:
        guessed = guessed.where(F.col("lang_pred").isin(*LANGUAGES))
    return guessed.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate group (shingles of five words, similarity 0.8), and one of rows with equal doc_id and text."""
    _bounded(spark)
    found = near_dedup.near_duplicates(docs)
    # only rows whose doc_id comes again have to meet, to be told from copies; the texts of all others stay where they are
    keep = found.where("component_id is null or doc_id = component_id").groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("n_rows"))
    kept = docs.select(*COLUMNS).join(keep, F.col("doc_id").eqNullSafe(F.col("kept")))
    return kept.where("n_rows = 1").select(*COLUMNS).unionByName(kept.where("n_rows > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a window of a benchmark item, each by its own text: an id that is null or that others have too plays no part."""
    _bounded(spark)
    return decontam.without_benchmark(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts; no document goes."""
    clean = secret_scan.redact(secret_scan.find_secrets(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, grouped into steps of equal tokens over all tasks; a row for each piece."""
    _bounded(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pack", pack),
]
#: The last stage's tokens can't be had in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:  # nothing reads it any more
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
