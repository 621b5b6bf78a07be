"""Connected groups of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.sources.files import kept


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is a group's least node.

    Each round a node takes the least root among its own and its neighbours', and so does its
    old root; then every node takes the root of its root. The number of rounds grows with the
    logarithm of the longest chain. A round is two aggregations and joins of the links, written
    to the shared folder; nothing but the number of changes reaches the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = kept(both.distinct(), "links")
    now = kept(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while True:
        seen = both.join(now.select(F.col("node").alias("b"), F.col("root").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        asked = now.join(seen, "node", "left").select("node", "root", F.least("root", F.coalesce("other", F.col("root"))).alias("new"))
        hooked = asked.select("node", "new").unionByName(asked.select(F.col("root").alias("node"), "new")).groupBy("node").agg(F.min("new").alias("root"))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        nxt = kept(hooked.join(above, "root").select("node", F.col("top").alias("root")), "roots")
        moved = nxt.join(now.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty()
        now = nxt
        if moved:
            return now
