"""Keyed tables: last row wins, insert if absent, resume, chunks, deterministic order and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the last in order."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order))))
    return ranked.where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it doesn't have."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def not_yet_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do after an interrupted run."""
    return todo.join(done.select(*keys), keys, "left_anti")


def chunks(rows: DataFrame, key: str, size: int, name: str = "batch") -> DataFrame:
    """rows with batch, the number of the chunk of size rows in the key's order.

    The rank is computed without one task that sees all rows: keys are sorted into ranges, and a range's keys are
    numbered from the number of rows before it. Both uses of the ranges need the same two columns, so Spark makes them
    once; made twice, from two samples, they could differ.
    """
    ranged = rows.groupBy(key).agg(F.count("*").alias("_n")).repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id())
    counted = ranged.groupBy("_part").agg(F.sum("_n").alias("_all"))
    ahead = lambda order: order.rowsBetween(W.unboundedPreceding, -1)
    before = counted.select("_part", F.coalesce(F.sum("_all").over(ahead(W.orderBy("_part"))), F.lit(0)).alias("_before"))  # a row per partition
    local = ranged.withColumn("_at", F.coalesce(F.sum("_n").over(ahead(W.partitionBy("_part").orderBy(key))), F.lit(0)))
    placed = local.join(F.broadcast(before), "_part").select(F.col(key).alias("_key"), (F.col("_before") + F.col("_at")).alias("_first"))
    tied = F.row_number().over(W.partitionBy("_key").orderBy("_first")) - 1
    joined = rows.join(placed, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.floor((F.col("_first") + tied) / size).cast("long")).drop("_key", "_first")


def hash_order(key: Column, seed: int) -> Column:
    """A text whose order is random but the same in every run and engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def sample_n(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows drawn without replacement."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def half_sample(rows: DataFrame, key: str, first: Column, seed: int, n: int) -> DataFrame:
    """n // 2 rows of those that are first, or as many as there are, and n - n // 2 of the others; rows are made once.

    Each is ranked by its hash among its like. What can't be among the first n is left out before rows are brought
    together, in parts of each kind.
    """
    most = n - n // 2
    marked = rows.withColumns({"_first": F.coalesce(first, F.lit(False)), "_hash": hash_order(F.col(key), seed)}).withColumn("_part", F.pmod(F.crc32("_hash"), F.lit(64)))
    ranked = lambda of, *by: of.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("_hash", key))).where(F.col("_n") <= most)
    least = ranked(ranked(marked, "_first", "_part"), "_first")
    return least.where(F.col("_n") <= F.when(F.col("_first"), n // 2).otherwise(most)).drop("_first", "_hash", "_part", "_n")


def stratified_sample(rows: DataFrame, key: str, stratum: str, seed: int, n: int) -> DataFrame:
    """At most n rows of each stratum."""
    order = W.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
