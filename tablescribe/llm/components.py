"""Connected components of links, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of the links ``a``, ``b`` (same type, not null).

    Each round links all neighbours of a node to the smallest one of them, first the larger neighbours, then the smaller
    ones, until nothing changes; then every node is linked to its root. The number of rounds grows with the logarithm of
    the longest chain. A round holds at most as many links as there were.
    """
    now = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _signature(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that both sides of the join are plain exchanges, of which a hub's large partition is split.
        smallest = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "smallest")
        larger = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        larger = materialize(larger, "links")
        smallest = materialize(larger.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        smaller = larger.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        now = materialize(smaller.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, seen = seen, _signature(now)
        if before == seen:
            break
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
