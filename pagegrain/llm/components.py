"""Connected components by alternating star contraction, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import measured_joins, save


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    around = _both(pairs)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    smaller = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node that has a link.

    Each round is a written table; rounds end when they change nothing, which takes about the logarithm of the size.
    """
    current = save(pairs.filter("a <> b").distinct(), "links")
    state = _state(current)
    while state[0]:
        with measured_joins(pairs.sparkSession):  # nodes of many links take few bytes in a file
            current = save(_small_star(_large_star(current)), "stars")
        if (after := _state(current)) == state:
            break
        state = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
