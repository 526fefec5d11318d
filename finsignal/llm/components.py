"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import write_table


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a link table: two numbers."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links(u, v) in any order and direction -> (u, root): each linked node with the smallest node of its component.

    Each round has two grouped minima and joins, all partitioned by node, and is written to the shared folder, so the
    plan stays short and lost executors cost one round at most. Rounds grow with the logarithm of the largest
    component. Nothing but two numbers a round reaches the driver. Links with a null end and self links add nothing.
    """
    edges = write_table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = write_table(small, "stars")
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.withColumnRenamed("v", "root").unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
