"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termpulse.llm.common import written


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``u, v``: for every node of a link but the smallest of its component, that one.

    ``links`` has columns ``u, v`` in any order. Each round connects every node to
    the smallest one near it, in one aggregation and one join per star; the number
    of rounds grows with the logarithm of the longest path. Minima are taken inside
    each task first, and the joins can be split when a node has very many links.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    edges = written(edges, "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        to_low = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = to_low.unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = written(small, "links")
    return edges
