"""Connected components of a graph given as a DataFrame of links.

Alternating large-star and small-star steps (Kiveris et al. 2014): every step
is a group-by, which adds up before it deals, and a lookup by vertex that spares
vertices with many links the shuffle, so no vertex's neighbours are gathered in
one place; only counts, a checksum and the few such vertices reach the driver per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")).select("u", F.least("u", "m").alias("m"), "links"))
    return lookup(both, least, "u", "links").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")))
    moved = lookup(down, least, "u", "links").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(u, root)`` for every vertex of ``links (u long, v long)`` but the roots themselves.

    Root: the smallest vertex of the component.  Self-links and repeated links
    change nothing; a link with a null end is left out; no links give no rows.
    The work per round follows the number of links; rounds grow with the
    logarithm of the longest path.
    """
    ends = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, before = cut(ends.distinct()), None
    for _ in range(rounds):
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select("u", F.col("v").alias("root"))
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
