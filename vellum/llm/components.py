"""Connected components of a link table by alternating large and small stars.

Each round joins links with the least neighbour of each node. A node with many links is
aggregated on the map side, and what it aggregates to is written before it is joined with its
links, so that Spark may split that join at a hot node. Rounds are cut through shared storage,
and only two numbers of each come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """node, component (its least member) of every node of links (u, v)."""
    links = scratch.cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    was, turn = None, 0
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if now == was or not now[0]:
            break
        was, turn = now, turn + 1
        links = scratch.cut(_small(_large(links, scratch, f"{name}-least-{turn}")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-least-{turn}")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
