"""Connected components of a link table in Spark, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm._common import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids to (id, root): each linked id that isn't the least of its component, and the least.

    Every step keeps the components and brings nodes nearer to their least one; O(log^2) rounds in theory, a few in
    practice. Nothing is collected but a count and a checksum of the links.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == before or mark[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = tuple(mark)
        both = edges.union(edges.select("v", "u")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()
        old, edges = edges, staged(small, "links")
        dropped(old)
