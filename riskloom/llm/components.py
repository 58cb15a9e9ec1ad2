"""Connected components of a link table by alternating star rounds.

Every round turns the links of each node towards the smallest node it sees; the rounds end with
one star per component. Tables are written between rounds, so lineage stays short, lost executors
cost one round, and the joins can split nodes with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored

MAX_ROUNDS = 60


def _smallest(links: DataFrame) -> DataFrame:
    return stored(links.groupBy("a").agg(F.min("b").alias("m")), "star-min")


def _size(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to one row (node, root) for each node with a link, root the smallest
    node of its component. Self-links and repeated or reversed links are allowed."""
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    links = links.filter("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct()
    links = stored(links, "star-links")
    before = _size(links)
    for _ in range(MAX_ROUNDS):
        # Large stars: all larger neighbours of a node move to the smallest in sight.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_smallest(both), "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        large = stored(large, "star-large")
        # Small stars: a node and its smaller neighbours move to the smallest of them.
        pairs = large.join(_smallest(large), "a")
        small = pairs.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = large.groupBy("a").agg(F.min("b").alias("b"))
        links = stored(small.unionByName(own).distinct(), "star-links")
        after = _size(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
    raise RuntimeError("components did not settle")
