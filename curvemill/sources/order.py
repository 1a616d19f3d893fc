"""The order in which rows stand in the files they are read from, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_read_order(rows: DataFrame, name: str = "ord") -> DataFrame:
    """rows, straight from a file source, with their number from 0: files by path, rows as they stand in a file.

    Spark reads files in splits, whose path and first byte are hidden columns. Within a split rows come one after
    another, so their increasing ids (which leave gaps between tasks) tell each one's place from the split's least id;
    the number of rows in all splits before comes from a table with a row for each split. The rows themselves are not
    shuffled, and their numbers do not depend on how the files are split or shared among tasks. A read that changes
    under the query, so that ids and splits don't fit, fails.
    """
    path, block, at = (f"_{name}_{part}" for part in ("path", "block", "id"))
    placed = rows.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(at))
    # the checksum makes both reads parse the same columns, so that both see the same rows
    splits = placed.groupBy(path, block).agg(F.min(at).alias("first"), F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("sum")).where("sum is not null")
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = splits.select(F.col(path).alias("file"), F.col(block).alias("start"), "first", "n").withColumn("before", before)
    known = known.select(*(F.col(c).alias(f"_{name}_{c}") for c in known.columns))
    mine = lambda c: F.col(f"_{name}_{c}")
    inside = F.col(at) - mine("first")
    number = F.when(inside.between(0, mine("n") - 1), mine("before") + inside).otherwise(F.raise_error(F.lit("the files changed while they were read")).cast("long"))
    joined = placed.join(known, (F.col(path) == mine("file")) & (F.col(block) == mine("start")))
    return joined.select(*rows.columns, number.alias(name))
