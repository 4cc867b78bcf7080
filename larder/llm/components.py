"""Connected components of a table of links, by alternating large and small stars.

Every round sends each node's smallest neighbour to its larger neighbours (large star), then to its
smaller ones (small star); a group of any shape becomes a star on its smallest node after a number
of rounds that grows with the logarithm of its size. Rounds are joins and map-side combined minima: minima are
stored before they are joined, so that both sides of a join are plain exchanges and Spark splits a node with
very many links. No links come to the driver, only two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import dropped, stored


def _least(links: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The smallest value of each key, as name and m. Stored."""
    return stored(links.groupBy(F.col(key).alias(name)).agg(F.min(value).alias("m")), "least")


def _large(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node's larger neighbours linked to its smallest; and a table that this reads."""
    both = links.select("a", "b").union(links.select("b", "a"))
    least = _least(both, "a", "b", "n")
    moved = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.least("a", "m").alias("a"), "b")
    return moved.filter("a <> b").distinct(), least


def _small(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node and its smaller neighbours linked to the smallest of them; and a table that this reads."""
    least = _least(links, "b", "a", "k")
    moved = links.join(least, F.col("b") == F.col("k")).select(F.col("m"), F.col("a").alias("s"))
    both = moved.select(F.col("m").alias("a"), F.col("s").alias("b")).union(least.select(F.col("m").alias("a"), F.col("k").alias("b")))
    return both.filter("a <> b").distinct(), least


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component, its smallest node reachable, of every node that has a link (a, b)."""
    now = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    now, before = stored(now, "links"), None
    for _ in range(rounds):
        large, read = _large(now)
        between = stored(large, "links")
        dropped(read)
        small, read = _small(between)
        then = stored(small, "links")
        dropped(read)
        dropped(between)
        # A star forest is a fixed point: same number of links and same sum of hashes.
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        dropped(now)
        now = then
        if mark == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = mark
    raise RuntimeError(f"links didn't settle within {rounds} rounds")
