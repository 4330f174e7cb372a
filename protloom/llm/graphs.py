"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import forget, saved

#: Links of a node from which its links are spread over the tasks. Of E links at most 2 E / HUB nodes are that large.
HUB = 50_000
#: Links in a file of an intermediate table.
LINKS_PER_FILE = 100_000


def _least(links: DataFrame, key: str, value: str, hub: int | None) -> DataFrame:
    """``links`` with ``m``, the least value of each key; a hub's rows stay where they are and get it by broadcast."""
    told = links.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n"))
    if hub is None:
        return links.join(told.drop("n"), key)
    large = F.broadcast(told.where(F.col("n") >= hub).drop("n"))  # rows are bounded by HUB
    rest = links.join(large, key, "left_anti").join(told.where(F.col("n") < hub).drop("n"), key)
    return rest.unionByName(links.join(large, key))


def _large_star(links: DataFrame, hub: int | None) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = _least(both, "u", "v", hub)
    return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(links: DataFrame, hub: int | None) -> DataFrame:
    near = _least(links, "a", "b", hub)
    return near.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, hub: int = HUB) -> DataFrame:
    """``node, root`` for every node of ``a, b`` links (longs); the root is the component's least node.

    Loops and repeated links do no harm; no links give an empty table.
    """
    spark = links.sparkSession
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = saved(now, "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        large = hub if mark[0] >= hub else None  # no node has more links than there are
        files = math.ceil(2 * mark[0] / LINKS_PER_FILE)
        following, new = saved(_small_star(_large_star(now, large), large).coalesce(files), "links")
        forget(spark, path)
        now, path = following, new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
