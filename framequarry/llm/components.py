"""Connected components of links held in a table, by alternating large and small stars.

Each round replaces links by links to the smallest neighbour, on both sides of a node in turn
(Kiveris et al., 2014); it ends when the links no longer change, as stars.  Rounds are cut by
checkpoints, minima are aggregated before the shuffle, and nothing but a count and a checksum
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of links (u, v: long, not null); links from a node to itself are ignored."""
    links = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(links)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u")
        small = below.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        links = cut(small.where("u <> v").distinct())
        mark, before = _mark(links), mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
