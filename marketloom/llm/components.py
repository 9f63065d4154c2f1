"""Connected components of a link table by alternating stars, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


def star(links: DataFrame) -> DataFrame:
    """One round: point every node's larger neighbours, then its smaller ones, at its least neighbour."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, u: Column | str = "u", v: Column | str = "v") -> DataFrame:
    """(node, root): each linked node with the least node it reaches, itself included; unlinked nodes are absent.

    Every round is written to the shared folder, so a lost executor repeats a round at most. Hot nodes are pre-aggregated
    to their least neighbour before any join; rounds grow with the logarithm of the longest path.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (u, v))
    now = staged(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = digest(now)
    while state[0]:
        now = staged(star(now))
        before, state = state, digest(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
