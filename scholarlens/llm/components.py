"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (a, b) with a > b.

    Large: each node's larger neighbours are tied to the least node around it.
    Small: each node and its smaller neighbours are tied to the least of those.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        tied = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return tied.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b).

    Each pass is a pair of aggregations with map-side partial sums; no list of
    neighbours is ever gathered. Rows with a null end or equal ends are ignored.
    The passes stop when every edge points at a root, which the star test reads
    from the written table; nothing but one count returns to the driver.
    """
    now = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        # a forest of stars: no node has two parents, and no parent has a parent itself
        several = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
        nested = now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a").limit(1)
        if several.select("a").unionByName(nested).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        then = stored(_star(_star(now, True), False), "edges")
        dropped(now)
        now = then
