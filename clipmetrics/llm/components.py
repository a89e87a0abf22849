"""Connected components of a link table by alternating large and small stars.

Every round is two aggregates and two joins on links; no component or neighbour list is gathered anywhere, and each
round's links are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmetrics.session import written


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest of the node and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """u, root of every linked node but the roots; links has columns u and v. Nodes and roots are compared as values.

    Null ends and links of a node to itself say nothing; an empty table gives no rows.
    """
    links = written(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = links.agg(F.count(F.lit(1)), mark).first()
    while before[0]:
        links = written(_small_star(_large_star(links)), "stars")
        after = links.agg(F.count(F.lit(1)), mark).first()
        if after == before:
            break
        before = after
    return links.select("u", F.col("v").alias("root"))
