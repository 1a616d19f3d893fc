"""Incremental ingest of curve rows: an extension, as the batch operators need no stream.

New files of a folder are read as a stream with availableNow, so a run takes what has come since the last and ends.
Each micro-batch appends the rows whose keys the table doesn't have yet; with the stream's checkpoint a batch that is
repeated after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.operators.tables import not_yet_done


def ingest(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keys: list[str]) -> int:
    """Append new rows of the Parquet files in source to the Parquet table; the number of rows that the table then has."""
    stream = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        try:
            done = spark.read.schema(schema).parquet(table)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = rows.limit(0)
        not_yet_done(rows, done, keys).write.mode("append").parquet(table)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(table).count()


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of (ts, event_type) in tumbling windows; rows later than delay are dropped by the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
