"""Connected components by alternating large-star and small-star steps.

Every step is a few shuffles over the links; its result is written to the shared
folder, so neither the plan nor the cost of a lost executor grows with the
number of steps. Nothing but two totals a step reaches the driver. FEW links or
less are one partition, in which a step shuffles nothing: the driver keeps a thread for
each exchange and broadcast of the last minute, and their stacks take more than the links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.storage import drop, written


#: Links (two longs) that one task takes at once.
FEW = 1 << 17


def _both_ways(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The links (a, b) and (c, d) of each row; a union would be two partitions at least."""
    return F.inline(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(c.alias("u"), d.alias("v"))))


def _with_least(links: DataFrame, few: bool) -> DataFrame:
    """Links and m, the least v of their u. In one partition a window needs no shuffle; elsewhere a join lets large stars be split."""
    if few:
        return links.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")).hint("shuffle_merge"), "u")


def _large_star(links: DataFrame, few: bool) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    both = _with_least(links.select(_both_ways(u, v, v, u)), few)
    return both.where("v > u").select(v.alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return _with_least(down, few).select(_both_ways(v, m, u, m)).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, component): component is the least node reachable; nodes without links are absent."""
    spark = links.sparkSession
    links = links.select("u", "v").where("u is not null and v is not null and u <> v")
    current, path = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    total_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = total_of(current)
    while True:
        few = before[0] <= FEW
        stepped, new_path = written(_small_star(_large_star(current.coalesce(1) if few else current, few), few), "links")
        total = total_of(stepped)
        drop(spark, path)
        current, path = stepped, new_path
        if total == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = total
