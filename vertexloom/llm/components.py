"""Connected components of a table of links, by alternating large-star and small-star steps on the links alone."""

from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut, discard


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) for every node b that is linked to a smaller one, a being the smallest node that b can reach.

    `links` has the columns a and b in either order; rows with equal ends and repeated rows don't matter. A step
    takes the minimum over a node's neighbours, which is summed up before the shuffle, and an equi-join.
    """
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # minima are written first: a join with an aggregate of the same stage can't be split at a node with very many links
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = cut(both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large")
        discard(least)
        least = cut(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x"))
        links, old = cut(small.select("x.a", "x.b").filter("a <> b").distinct(), "links"), links
        for table in (least, large, old):
            discard(table)
        now = _state(links)
        if now == before:
            break
        before = now
    return links
