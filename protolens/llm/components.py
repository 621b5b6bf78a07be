"""Connected components of a link table by alternating large-star and small-star steps.

Each round is two aggregations and joins of the links, written to the shared folder; the
number of rounds grows with the logarithm of the longest chain. Links and components never
leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.llm._util import discard, stage


#: Links of a task; a small table is not spread over every partition of a shuffle.
LINKS = 50_000


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Each node's neighbours are linked to the least node among them and itself: those above
    the node (large star), or those below and the node (small star)."""
    if large:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        near = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
        moved = moved.unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return moved.where("a < b").select("a", "b").coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is the least node."""
    spark = links.sparkSession
    tasks = 1 + links.count() // LINKS
    now = stage(links.coalesce(tasks).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(tasks), "links")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        nxt = stage(_star(_star(now, True, tasks), False, tasks), "links")
        after = mark(nxt)
        discard(spark, now)
        now, same = nxt, after == before
        before = after
        if same:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
