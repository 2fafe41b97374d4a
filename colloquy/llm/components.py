"""Connected components of a link table that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hot, settle


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("_n"))
    return join_hot(both.filter("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    moved = join_hot(down, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), root being the least node that it can reach.

    Alternating large-star and small-star passes; each pass is a partial aggregation and an
    equi-join that deals hot hubs out, and is written to the shared folder. Null
    ends, self-links and repeats are dropped. An empty table gives an empty table.
    """
    now, path = settle(links.filter("a <> b").select("a", "b").distinct(), "links")
    mark = _checksum(now)
    while mark[0]:
        stars, last = settle(_small_star(_large_star(now)).distinct(), "links")
        forget(path)
        now, path, before = stars, last, mark
        mark = _checksum(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
